"""Variant spellings of names, by merge-and-rematch resolution against a register.

Every spelling is parsed into a record (family name, given name, initials,
titles; or an organisation's words). Registered records are resolved among themselves
first: full names that match become one profile, which unions its members'
spellings and initials. Then every other spelling is matched, in rounds: all
records without a profile enter blocking with the profiles,
records that match exactly one profile merge into it, the profiles they made richer
re-enter blocking (what met the others is kept), and the rounds end when nothing merges any more.

Blocking is by deletion neighbourhoods of phonetically reduced names (two
spellings two edits apart share a key), so no two records are compared unless
they share one, and records only ever meet profiles: the work is linear in
the number of distinct spellings. Only distinct spellings are shuffled, never documents;
the last join brings the result back to the documents.

Defined results: null and blank names, and names that fit no profile or fit
several equally well, have no row; a name given as an initial or by the family
name alone needs a single profile it can mean; repeated documents give repeated
rows; further columns are ignored; an empty register gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.plans.components import connected_components
from chronolex.plans.materialize import drop_materialized, materialize

ROLES = set(
    "chair chairman chairwoman chairperson vice first second president governor director of research senior junior adviser advisor professor prof "
    "reporter dr hon honorable honourable mr mrs ms mx miss sir dame lord secretary moderator panelist panellist member commissioner deputy chief "
    "economist officer analyst editor the acting former staff speaker governor-elect general counsel treasurer manager head senator congressman congresswoman representative rep sen gov pres".split()
)
ORG_WORDS = set(
    "bank board university institute council committee ledger dispatch review secretariat office reserve journal times gazette tribune herald news college "
    "centre center department ministry association federation foundation society agency bureau commission company group fund markets economic study".split()
)
#: Short forms of words in names of organisations.
SHORT = {
    "res": "reserve", "bk": "bank", "inst": "institute", "econ": "economic", "univ": "university", "cmte": "committee", "comm": "committee", "dept": "department", "natl": "national",
    "intl": "international", "assn": "association", "mkts": "markets", "rev": "review", "sec": "secretariat", "cncl": "council", "bd": "board", "ctr": "center",
}
_SMALL = {"of", "and", "for", "the", "on", "in", "at", "&"}
#: English short forms of given names that are no beginnings of them, or of several, and what they stand for.
#: General usage, not taken from any register; :func:`short_form` knows beginnings of three letters or more.
NICKNAMES = {
    "abby": "abigail", "abbie": "abigail", "gail": "abigail", "al": "albert alan alexander alfred", "alex": "alexander alexandra", "sandy": "alexander alexandra", "andy": "andrew", "drew": "andrew", "tony": "anthony",
    "art": "arthur", "barb": "barbara", "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "betsy": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "bert": "robert albert", "becky": "rebecca", "becca": "rebecca",
    "cathy": "catherine", "kate": "katherine catherine", "katie": "katherine catherine", "kathy": "katherine", "kat": "katherine", "kit": "katherine christopher", "charlie": "charles", "chuck": "charles", "chris": "christopher christina christine christian",
    "tina": "christina", "christy": "christina", "dan": "daniel", "danny": "daniel", "dave": "david", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "don": "donald", "doug": "douglas", "ed": "edward edwin", "eddie": "edward",
    "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "frank": "francis franklin", "fred": "frederick", "freddie": "frederick", "rick": "richard frederick", "gabby": "gabriela gabriel", "gabi": "gabriela", "gabe": "gabriel", "geoff": "geoffrey",
    "george": "georgina", "greg": "gregory", "hank": "henry", "harry": "henry harold", "rik": "henrik", "jack": "john", "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald jerome",
    "joe": "joseph", "joey": "joseph", "jo": "joseph josephine joanna", "josh": "joshua", "ken": "kenneth", "larry": "lawrence", "laurie": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "maggie": "margaret", "meg": "margaret",
    "peg": "margaret", "peggy": "margaret", "marge": "margaret", "greta": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "mickey": "michael", "nate": "nathaniel nathan", "nat": "nathaniel", "nick": "nicholas", "pat": "patricia patrick",
    "patty": "patricia", "tricia": "patricia", "trish": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond", "dick": "richard", "rich": "richard", "ron": "ronald", "sam": "samuel samantha", "steve": "stephen steven", "steph": "stephanie",
    "sue": "susan", "susie": "susan", "suzy": "susan", "thea": "theodora dorothea", "dora": "theodora", "theo": "theodora theodore", "tom": "thomas", "tommy": "thomas", "tim": "timothy", "vic": "victor victoria", "vicky": "victoria", "vicki": "victoria",
    "gaby": "gabriela gabriel", "pepe": "jose", "pepito": "jose", "paco": "francisco", "pancho": "francisco", "nacho": "ignacio", "lola": "dolores", "chuy": "jesus", "manny": "manuel emmanuel", "sasha": "alexander alexandra",
    "misha": "mikhail michael", "kolya": "nikolai", "katya": "katherine ekaterina", "natasha": "natalia", "tanya": "tatiana", "hal": "henry harold", "sally": "sarah", "molly": "mary margaret", "polly": "mary", "nan": "nancy anne",
    "annie": "anne ann", "nell": "eleanor helen", "nora": "eleanor honora", "ellie": "eleanor elizabeth", "lena": "helena magdalena", "jeff": "jeffrey geoffrey", "jon": "jonathan", "johnny": "john", "lou": "louis louise", "mandy": "amanda",
    "cindy": "cynthia", "ginny": "virginia", "hettie": "henrietta", "kim": "kimberly", "max": "maximilian maxwell", "nicky": "nicholas nicole", "ollie": "oliver olivia", "reggie": "reginald", "russ": "russell", "sid": "sidney",
    "stan": "stanley", "stu": "stuart", "terry": "terence theresa", "tess": "theresa", "val": "valerie valentine", "wes": "wesley", "jake": "jacob", "abe": "abraham", "gus": "augustus gustav", "hans": "johannes", "fritz": "friedrich",
    "tori": "victoria", "walt": "walter", "wendy": "gwendolyn", "zach": "zachary",
}


def plain(text: str) -> str:
    """Lower case without accents; digits that stand for letters within a word become letters."""
    t = text.lower().replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("đ", "d").replace("ł", "l")
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = re.sub(r"(?<=[a-z])1|1(?=[a-z])", "l", t)
    t = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", t)
    return re.sub(r"(?<=[a-z])5|5(?=[a-z])", "s", t)


def sound(word: str) -> str:
    """A spelling reduced by sound: alike-sounding letters are one, doubled letters single."""
    w = re.sub(r"[^a-z]", "", word)
    for a, b in (("ks", "x"), ("ck", "k"), ("ph", "f"), ("th", "t"), ("sch", "sh"), ("qu", "kw"), ("w", "v"), ("z", "s"), ("c", "k"), ("y", "i"), ("j", "i")):
        w = w.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", w)


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours from a to b; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def apart(a: str, b: str, most: int) -> float:
    """Edits between two names as spelled or as they sound, whichever is less; a like sound counts half an edit."""
    d = edits(a, b, most)
    if d <= 0:
        return 0
    s = edits(sound(a), sound(b), most)
    return min(d, s + 0.5)


def deletions(word: str) -> set[str]:
    """The word with up to two letters left out (one, for words under six letters)."""
    out = {word}
    for k in (1, 2) if len(word) >= 6 else (1,) if len(word) >= 4 else ():
        out |= {"".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(len(word)), k)}
    return out


def parse(name: str | None, title: str | None = None) -> dict | None:
    """A record: ``family, given, initials, titles`` of a person reading and ``words, letters`` of an organisation reading."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", name or "")).strip()
    text = re.sub(r"\(.*?\)|\[.*?\]", " ", text)
    text = re.sub(r"[*†‡\"“”]", " ", text)
    text = re.sub(r",\s*(press office|media office|staff|newsroom)\s*$", " ", text, flags=re.IGNORECASE)
    text = re.sub(r"\s+", " ", text).strip(" ,;:.-")
    if not re.search(r"[^\W\d_]", text):
        return None
    record = {"family": "", "given": "", "initials": "", "titles": "", "words": "", "letters": ""}
    if (title or "").lower() == "institution":
        record["titles"] = "institution"
    joined = re.sub(r"[.\s]", "", text)
    tokens = [re.sub(r"[^a-z'-]", "", plain(t)) for t in text.replace(",", " ").split()]
    words = [SHORT.get(t, t) for t in tokens if t and t not in _SMALL]
    if " " not in text and re.fullmatch(r"[A-Z]{2,}", joined):
        # with full stops an acronym; without, it may be a family name in capitals as well
        record["letters"] = joined.lower()
        if "." in text:
            return record
    if len(words) >= 2 and not re.search(r"\b[A-Z]\b", text):
        record["words"] = " ".join(words)
    if record["titles"] == "institution" or len(ORG_WORDS.intersection(words)) >= 1 and len(words) >= 2:
        record["words"] = " ".join(words)
        record["titles"] = "institution"
        return record
    # a person: role words before the name, or after the last comma
    parts = [p.strip() for p in text.split(",") if p.strip()]
    titles: list[str] = []
    while len(parts) > 1 and all(t in ROLES for t in plain(parts[-1]).replace(".", " ").split()):
        titles = plain(parts.pop()).replace(".", " ").split() + titles
    tokens = parts[0].split()
    while len(tokens) > 1 and plain(tokens[0]).strip(".") in ROLES:
        titles.append(plain(tokens.pop(0)).strip("."))
    if len(parts) > 1:  # Family, Given M. / Family, GM
        family, rest = tokens, parts[1].split()
        while len(rest) > 1 and plain(rest[0]).strip(".") in ROLES:
            titles.append(plain(rest.pop(0)).strip("."))
    elif len(tokens) >= 2 and len(tokens[0]) > 2 and "." not in tokens[0] and tokens[0].isupper() and not tokens[1].isupper():  # FAMILY Given
        family, rest = tokens[:1], tokens[1:]
    else:
        family, rest = tokens[-1:], tokens[:-1]
    given, initials = "", ""
    for t in rest:
        bare = t.replace(".", "")
        if len(bare) == 1 or ("." in t and len(bare) <= 3 and bare.isupper()) or (len(bare) <= 3 and bare.isupper() and len(parts) > 1):
            initials += plain(bare)
        elif not given and not initials:
            given = re.sub(r"[^a-z-]", "", plain(t))
        elif not given:
            given = re.sub(r"[^a-z-]", "", plain(t))
        else:
            initials += plain(t)[:1]
    record["family"] = re.sub(r"[^a-z'-]", "", plain("".join(family)))
    record["given"], record["initials"], record["titles"] = given, (given[:1] + initials if given else initials), " ".join(titles)
    return record if record["family"] or record["words"] or record["letters"] else None


def keys(record: dict) -> list[int]:
    """Blocking keys: the neighbourhood of the family name, and of each word of an organisation."""
    out: set[str] = set()
    if record["family"]:
        out |= {"f" + k for k in deletions(sound(record["family"]))} | {"f" + k for k in deletions(record["family"])}
    if record["words"]:
        words = record["words"].split()
        out |= {"w" + k for w in words for k in ({w} | {w[:i] + w[i + 1 :] for i in range(len(w))}) if len(w) > 3}
        out |= {"a" + "".join(w[0] for w in words)}
    if record["letters"]:
        out |= {"a" + record["letters"]}
    return [xxhash.xxh3_64_intdigest(k) - 2**63 for k in sorted(out)]


def short_form(a: str, b: str) -> bool:
    """Whether one given name is a beginning of the other."""
    return min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a))


def _given(a: str, b: str) -> float:
    """How far two given names are apart; 9: not the same."""
    if a == b:
        return 0
    if short_form(a, b):
        return 0.5
    if b in NICKNAMES.get(a, "").split() or a in NICKNAMES.get(b, "").split() or set(NICKNAMES.get(a, "-").split()) & set(NICKNAMES.get(b, "+").split()):
        return 0.25
    most = 2 if min(len(a), len(b)) >= 6 else 1
    d = apart(a, b, most)
    return d if d <= most else 9


def score(r: dict, p: dict) -> tuple[int, float] | None:
    """How a record fits a profile: (tier, distance), the less the better; None: not at all.

    Tier 0: a full name; 1: initials and family name; 2: family name alone. A
    profile has lists of the fields; its first ``own`` families and words are
    registered spellings, the others were merged in and must be met more closely.
    Two edits are allowed between names of seven letters or more, one between shorter ones
    (a like sound counts half an edit): two edits in six letters make another name.
    """
    best: tuple[int, float] | None = None
    if r["letters"] and r["letters"] in p["letters"]:
        return 1, 0.0
    if r["words"] and p["words"]:
        mine = "".join(sorted(r["words"].split()))
        straight = r["words"].replace(" ", "")
        for i, w in enumerate(p["words"]):
            most = 2 if len(mine) < 18 else 3
            if i >= p["own"]:
                most = 1
            d = min(edits(straight, w.replace(" ", ""), most), edits(" ".join(sorted(r["words"].split())), " ".join(sorted(w.split())), most))
            if d <= most and (best is None or (0, d) < best):
                best = (0, float(d))
    if r["family"] and p["families"]:
        d_family = 9.0
        for i, f in enumerate(p["families"]):
            most = 2 if min(len(f), len(r["family"])) >= 7 else 1
            if i >= p["own"]:
                most = 1
            d = apart(r["family"], f, most)
            d_family = min(d_family, d if d <= most else 9.0)
        if d_family > 2.5:
            return best
        found: tuple[int, float] | None = None
        if r["given"] and p["givens"]:
            d_given = min(_given(r["given"], g) for g in p["givens"])
            if d_given <= 2 and d_family + d_given <= 3:
                clash = len(r["initials"]) > 1 and any(len(i) > 1 for i in p["initials"]) and r["initials"][1] not in {i[1] for i in p["initials"] if len(i) > 1}
                found = (0, d_family + d_given + (0.5 if clash else 0))
        elif r["given"]:  # the profile has only initials
            if r["given"][0] in {i[0] for i in p["initials"] if i} and d_family <= 1.5:
                found = (1, d_family)
        elif r["initials"]:
            firsts = {i[0] for i in p["initials"] if i} | {g[0] for g in p["givens"]} | {full[0] for g in p["givens"] for full in NICKNAMES.get(g, "").split()}
            if r["initials"][0] in firsts and d_family <= 1.5:
                middles = {i[1] for i in p["initials"] if len(i) > 1}
                clash = len(r["initials"]) > 1 and middles and r["initials"][1] not in middles
                agrees = len(r["initials"]) > 1 and r["initials"][1] in middles
                found = (1, d_family + (0.5 if clash else 0) - (0.25 if agrees else 0))
        elif d_family <= 1.5:
            role = bool(set(r["titles"].split()) & set(" ".join(p["titles"]).split()) - {"of", "the"})
            found = (2, d_family - (0.25 if role else 0))
        if found and (best is None or found < best):
            best = found
    return best


_FIELDS = ("family", "given", "initials", "titles", "words", "letters")
_RECORD = "rid string, sid long, family string, given string, initials string, titles string, words string, letters string, keys array<long>"


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _parse_all(df: DataFrame) -> DataFrame:
    """Records of ``rid, sid, name, title, role``; ``titles`` gets the register's title too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, sid, name, title in zip(b["rid"], b["sid"], b["name"], b["title"]):
                r = parse(name, title)
                if r:
                    if title and r["titles"] != "institution":
                        r["titles"] = " ".join(dict.fromkeys((r["titles"] + " " + plain(title)).split()))
                    rows.append([rid, sid, *(r[f] for f in _FIELDS), keys(r)])
            yield pd.DataFrame(rows, columns=["rid", "sid", *_FIELDS, "keys"])

    # few bytes but much work each: keep the planner from putting all names in one task
    return df.select("rid", "sid", "name", "title").repartition(_tasks(df), "rid").mapInPandas(run, _RECORD)


def _profiles(members: DataFrame) -> DataFrame:
    """One row per ``pid``: the union of its members' spellings; registered ones come first."""
    listed = lambda c, own: F.array_sort(F.collect_set(F.when((F.col(c) != "") & F.col("own") if own else (F.col(c) != "") & ~F.col("own"), F.col(c))))
    both = lambda c: F.concat(listed(c, True), F.array_except(listed(c, False), listed(c, True)))
    out = members.withColumn("own", F.col("sid").isNotNull()).groupBy("pid").agg(
        F.size(F.collect_set(F.when((F.col("family") != "") & F.col("own"), F.col("family")))).alias("own_families"),
        F.size(F.collect_set(F.when((F.col("words") != "") & F.col("own"), F.col("words")))).alias("own_words"),
        both("family").alias("families"), both("given").alias("givens"), both("initials").alias("initials"), both("titles").alias("titles"), both("words").alias("words"),
        F.array_union(
            F.collect_set(F.when(F.col("letters") != "", F.col("letters"))),
            F.collect_set(F.when((F.col("words") != "") & F.col("own") & F.col("titles").contains("institution"), F.regexp_replace("words", "([a-z])[^ ]* ?", "$1"))),
        ).alias("letters"),
        F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys"),
    )
    acronym = F.transform("letters", lambda x: F.xxhash64(x))
    return out.withColumn("acronyms", acronym)


def _fits(records: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rid, pid, tier, d`` of all records and profiles that share a key and fit."""
    r = records.select(F.explode("keys").alias("key"), "rid")
    p = profiles.select(F.explode("keys").alias("key"), "pid")
    met = r.join(p, "key").select("rid", "pid").distinct()
    paired = met.join(records.select("rid", *_FIELDS), "rid").join(
        profiles.select("pid", "own_families", "own_words", "families", "givens", *[F.col(c).alias("p_" + c) for c in ("initials", "titles", "words", "letters")]), "pid"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.itertuples(index=False):
                r = {f: getattr(x, f) for f in _FIELDS}
                p = {"families": list(x.families), "givens": list(x.givens), "initials": list(x.p_initials), "titles": list(x.p_titles), "words": list(x.p_words), "letters": list(x.p_letters)}
                p["own"] = x.own_words if r["words"] and not r["family"] else x.own_families or x.own_words
                s = score(r, p)
                if s:
                    rows.append((x.rid, x.pid, s[0], s[1]))
            yield pd.DataFrame(rows, columns=["rid", "pid", "tier", "d"])

    # by a hash of their own: a partitioning that a join left would be taken over and its small partitions put together
    return paired.repartition(_tasks(records), F.xxhash64("pid", "rid")).mapInPandas(run, "rid string, pid long, tier int, d double")


def _sole(fits: DataFrame) -> DataFrame:
    """``rid, pid`` of the records with one best profile."""
    best = F.min(F.struct("tier", "d")).over(Window.partitionBy("rid"))
    top = fits.withColumn("best", best).filter((F.col("tier") == F.col("best.tier")) & (F.col("d") <= F.col("best.d")))
    return top.groupBy("rid").agg(F.min("pid").alias("pid"), F.count_distinct("pid").alias("n")).filter("n = 1").select("rid", "pid")


def resolve_register(records: DataFrame) -> DataFrame:
    """Members ``pid, <record>`` of the registered profiles; ``pid`` is the least register id.

    Full names first: those that fit one another are joined and their components are the
    profiles. Names with initials or a family name only then merge into the one
    profile they can mean, or stand alone.
    """
    records = materialize(records, "register")
    full = F.expr("(given <> '' and family <> '') or titles = 'institution' and words <> ''")
    strong, weak = records.filter(full), records.filter(~full)
    each = _profiles(strong.withColumn("pid", F.col("sid")))
    alike = _fits(strong, each).filter("tier = 0 and d <= 2").select(F.col("rid").substr(2, 20).cast("long").alias("a"), F.col("pid").alias("b")).filter("a <> b")
    groups = connected_components(alike).select(F.col("id").alias("sid"), F.col("component").alias("pid"))
    members = materialize(strong.join(groups, "sid", "left").withColumn("pid", F.coalesce("pid", "sid")), "members")
    sole = _sole(_fits(weak, _profiles(members)))
    rest = weak.join(sole, "rid", "left").withColumn("pid", F.coalesce("pid", "sid"))
    everyone = materialize(members.unionByName(rest), "members")
    least = everyone.groupBy("pid").agg(F.min("sid").alias("least"))
    return everyone.join(least, "pid").drop("pid").withColumnRenamed("least", "pid").select("pid", *records.columns)


def resolve_names(names: DataFrame, register: DataFrame, name_col: str = "speaker_name") -> DataFrame:
    """``name_col, speaker_id``: each distinct spelling that refers to one registered profile.

    ``register``: ``id, name, title``.
    """
    registered = _parse_all(register.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("rid"), F.col("id").cast("long").alias("sid"), "name", "title").dropDuplicates(["rid"]))
    members = materialize(resolve_register(registered), "profile-members")
    spellings = names.select(F.col(name_col).alias("name")).filter("trim(name) <> ''").distinct()
    open_ = _parse_all(spellings.select(F.concat(F.lit("n"), F.col("name")).alias("rid"), F.lit(None).cast("long").alias("sid"), "name", F.lit(None).cast("string").alias("title")))
    open_ = materialize(open_, "spellings")
    found = []
    fits = materialize(_fits(open_, _profiles(members)), "fits")
    while True:
        sole = materialize(_sole(fits), "merged")
        if sole.isEmpty():
            break
        found.append(sole)
        before = (members, open_, fits)
        merged = open_.join(sole, "rid").select("pid", *open_.columns)
        members = materialize(members.unionByName(merged), "profile-members")
        open_ = materialize(open_.join(sole, "rid", "left_anti"), "spellings")
        richer = sole.select("pid").distinct()
        # only the profiles that merged something are met anew
        kept = fits.join(sole, "rid", "left_anti").join(richer, "pid", "left_anti")
        again = _fits(open_, _profiles(members.join(richer, "pid", "left_semi")))
        fits = materialize(kept.unionByName(again.select(*kept.columns)), "fits")
        for table in before:
            drop_materialized(table)
    if not found:
        return members.limit(0).select(F.col("rid").alias(name_col), F.col("pid").alias("speaker_id"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.expr("substring(rid, 2)").alias(name_col), F.col("pid").alias("speaker_id"))


def link_documents(documents: DataFrame, register: DataFrame, id_col: str = "doc_id", name_col: str = "speaker_name") -> DataFrame:
    """``id_col, speaker_id`` of every document whose name refers to a registered person or organisation."""
    resolved = materialize(resolve_names(documents, register, name_col), "resolved-names")
    return documents.select(id_col, name_col).join(resolved, name_col).select(id_col, "speaker_id")

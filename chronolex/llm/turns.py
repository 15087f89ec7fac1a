"""Speaker turns from the segments of transcripts.

1. Each (document, segment) is taken once and read on its own, in one pass: headers
   give the document's roster (the persons in order with family name, given name
   and role); in other segments time marks and sound notes go out, possible labels
   cut the text into stretches, words other than hesitation sounds are counted.
   No text goes further than this.
2. The distinct labels of a document meet its roster in phonetic blocks (names
   alike up to deletions, as spelled or as they sound; an exact match is the block
   without deletions). An optimal assignment with the least total distance gives
   every name a person; a person may be given to several names, at a small charge
   for each after the first.
3. Names that no block of their own roster holds meet the rosters of all
   transcripts in blocks of sound; a second assignment gives them to persons of the
   own roster whom no other label named; what stays takes the family name as other
   headers spell it. A form that only a known name makes a label is text otherwise.
4. Window functions order the stretches: a stretch without label and name takes
   the last speaker, stretches without words drop out, neighbours of one speaker
   are one turn.

Only rosters and distinct labels are gathered per document; the segments of
a document stay rows, so a document of any length streams through a window.

Defined results: null texts have no words; segments with a null document or
index are no turns; a document without any header is labelled by the labels'
own family names; before the first named speaker the speaker is null and the
stretch is a turn of its own; ties of repeated segments go to the earliest row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolex.llm.names import ROLES, deletions, edits, parse, plain, sound
from chronolex.plans.materialize import materialize

_TIME = re.compile(r"\[\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?(?:\s*(?:-->?|–|—|to)\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?)?\s*\]|<\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?\s*>|\(\s*\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?\s*\)")
#: Words that make a bracketed note a sound or recording note.
_NOTE_WORDS = (
    "applause|applauds?|clapping|cheers|cheering|laughs?|laughter|laughing|chuckles?|chuckling|giggles?|pauses?|silence|music|crosstalk|cross-talk|cross talk|overtalk|overlapping|inaudible|unintelligible|indiscernible|"
    "coughs?|coughing|sighs?|sneezes?|sniffs?|clears throat|throat|noise|noises|static|feedback|echo|beep|beeps|bell|rings?|ringing|door|phone|microphone|mic|gavel|rustling|shuffling|whispers?|whispering|murmurs?|audio|"
    "off-mic|off mic|no audio|recording|technical|background|gasps?|booing|sound|footsteps|typing|siren|tape"
)
_NOTE = re.compile(rf"<<[^<>]*>>|\{{[^{{}}]*\}}|(?<!\*)\*(?!\*)[^*\n]{{1,40}}\*(?!\*)|[\[(]\s*(?:[\w'-]+\s+){{0,2}}(?:{_NOTE_WORDS})(?:\s+[\w'-]+){{0,2}}\s*[.!]?\s*[\])]", re.IGNORECASE)
_SOUND = r"(?:u+h+m*|u+m+|e+r+m*|a+h+|m{2,}|h+m+)"
_HESITATION = re.compile(rf"(?<![\w'’-]){_SOUND}(?:-{_SOUND})*(?![\w'’-])", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]")
_TOKEN = r"(?:[^\W\d_]\.|(?:[Mm][RrSsXx]|[Mm][Rr][Ss]|[Dd][Rr]|[Hh][Oo][Nn]|[Pp][Rr][Oo][Ff])\.|[^\W\d_a-zß-ÿ][\w'’-]*)"
_LABEL = re.compile(
    rf"<v\s+(?P<v>[^<>\n]{{1,80}})>"
    rf"|\*\*(?P<b>[^*\n]{{1,80}}?):?\*\*:?"
    rf"|\[(?P<k>[^\[\]\n\d]{{1,60}})\]:?"
    rf"|>>\s*(?P<g>[^:\n]{{1,60}}):"
    rf"|(?<![\w'’-])(?P<p>{_TOKEN}(?: {_TOKEN}){{0,4}}) \([^()\n\d]{{1,30}}\):"
    rf"|(?<![\w'’-])(?P<n>{_TOKEN}(?:,? (?:of|{_TOKEN})){{0,5}}) ?(?P<e>[:.—])(?=\s|$)"
    rf"|(?<![\w'’-])(?P<q>Q|QUESTION|Question|A|ANSWER|Answer)\.(?=\s)"
)
_ASKS = {"q", "question", "questioner", "audience", "audience member", "unidentified questioner"}
_ANSWERS = {"a", "answer"}
_MARKS = _ASKS | _ANSWERS
_HEAD = re.compile(r"^[^:—;]{0,40}?(?::|—)\s*")


def read_header(text: str) -> list[tuple[str, str, str]]:
    """``(family, given, role)`` of the persons a header names, in order; none if it names nobody."""
    m = _HEAD.match(text or "")
    if not m:
        return []
    people = []
    for entry in text[m.end() :].split(";"):
        role = re.search(r"\(([^()]*)\)", entry)
        name = re.sub(r"\(.*?\)", " ", entry)
        name, _, title = name.partition(",")
        words = name.split()
        if not words or not all(w[0].isupper() for w in words):
            continue
        people.append((words[-1].strip(".,;").lower(), plain(" ".join(words[:-1])), plain(title.strip() or (role.group(1) if role else ""))))
    return people


class _Memo(dict):
    """A function's values, kept for up to ``most`` arguments and then gathered anew."""

    def __init__(self, function, most: int = 200_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.function(key)
        return value


def _read_label(label: str) -> tuple[str, list[str], int, str]:
    """``(plain form, words, leading role words, family name as parsed)`` of a label."""
    bare = plain(label).strip(" .:,*")
    words = [w for w in re.split(r"[\s.,]+", bare) if w]
    titles = 0
    while titles < len(words) and words[titles] in ROLES:
        titles += 1
    record = parse(label) if titles < len(words) else None
    return bare, words, titles, record["family"] if record else ""


def _blocks(name: str) -> frozenset[str]:
    """Blocks a name is in: itself with letters left out, as spelled and as it sounds."""
    return frozenset(deletions(name) | {"~" + k for k in deletions(sound(name))})


_readings, _block_keys = _Memo(_read_label), _Memo(_blocks)
#: Cost of leaving a name without a person, and of giving one person to one more name.
UNPLACED, SHARED = 3.0, 0.3


def _apart(name: str, other: str) -> float:
    """Distance of two names of one block; more than 2: not the same."""
    a, b = sound(name), sound(other)
    if a == b:
        return 0.25
    most = 2 if min(len(name), len(other)) >= 6 else 1
    d = min(edits(name, other, most), edits(a, b, most))
    return float(d) if d <= most else 9.0


class Roster:
    """A document's persons; finds whom labels mean."""

    def __init__(self, people: list[tuple[str, str, str]]):
        self.people = people
        self.exact: dict[str, str] = {}
        for family, _, _ in people:
            self.exact.setdefault(plain(family), family)

    def role(self, words: list[str]) -> str | None:
        """The person with this role; the main speaker where no person has it."""
        text = " ".join(words)
        for test in (lambda r: r == text, lambda r: r.endswith(text) or text.endswith(r) and r):
            for family, _, role in self.people:
                if test(role):
                    return family
        return self.people[0][0] if self.people else None

    def place(self, names: list[str]) -> dict[str, str]:
        """The persons of family names, by blocks and least total distance; names of nobody are left out."""
        if all(n in self.exact for n in names):  # at cost 0 each: no assignment is better
            return {n: self.exact[n] for n in names}
        held = defaultdict(set)
        for known in self.exact:
            for k in _block_keys[known]:
                held[k].add(known)
        edges = []
        for n in names:
            met = set().union(*(held[k] for k in _block_keys[n] if k in held))
            far = {m: 0.0 if m == n else _apart(n, m) for m in sorted(met)}
            edges.append({m: d for m, d in far.items() if d <= 2})
        columns = [(m, copy) for m in self.exact for copy in range(sum(m in e for e in edges))]
        costs = [[e[m] + SHARED * copy if m in e else 2 * UNPLACED for m, copy in columns] + [UNPLACED] * len(names) for e in edges]
        return {n: self.exact[columns[j][0]] for n, j in zip(names, assign(costs)) if j < len(columns)}

    def resolve(self, labels: list[tuple[str, str]]) -> list[tuple[bool, str | None, str | None]]:
        """``(is a label, speaker, odd family name)`` of labels with their form (see :func:`read_segment`)."""
        read = []
        for label, _ in labels:
            bare, words, titles, family = _readings[label]
            known = next((i for i, w in enumerate(words[:titles]) if w in self.exact), titles)
            words, titled = words[known:], known > 0
            if bare in _ASKS:
                read.append(("question", None, True))
            elif bare in _ANSWERS:
                read.append((self.people[0][0] if self.people else None, None, True))
            elif words:
                names = [w for w in (family, words[-1], words[0]) if w]
                read.append((None, next((w for w in names if w in self.exact), names[0]), titled))
            else:
                named = [w for w in _readings[label][1] if w != "the"]
                read.append((self.role(named) if named else None, None, True))
        meant = self.place(list(dict.fromkeys(name for _, name, _ in read if name)))
        out = []
        for (label, form), (who, name, titled) in zip(labels, read):
            who = who or meant.get(name)
            odd = name if who is None else None
            if form == "n.":
                taken = bool(titled and who and (label.isupper() or len(label.split()) > 1))
            elif form == "n—":
                taken = who is not None
            elif form == "n:":
                taken = who is not None or odd is not None and (titled or label.isupper() and len(label) > 3)
            elif form == "k":
                taken = who is not None and (who != "question" or plain(label) in _ASKS)
            elif form == "p":
                taken = who is not None or odd is not None
            else:
                taken = True
            out.append((taken, who if taken else None, odd if taken else None))
        return out


def _count(token: str) -> int:
    return sum(1 for w in _HESITATION.sub(" ", token).split() if _WORD.search(w))


_counts = _Memo(_count)


def _words(text: str) -> int:
    """Words of a text without hesitation sounds, which never reach over white space."""
    return sum(map(_counts.__getitem__, text.split()))


_BRACKET = re.compile(r"[\[<({*]")
#: Beside the start of a text, a label may stand on a new line or after a sentence.
_END = re.compile(r"[.?!…\n:—][”\")]?[ \t]*")
_is_mark = _Memo(lambda label: len(label) < 30 and plain(label).strip(".") in _MARKS)


def _labels(text: str) -> Iterator[tuple[int, int, str, str]]:
    """``start, end, form, label`` of what may be labels."""
    end, size = 0, len(text)
    for at in [size - len(text.lstrip(" \t")), *(s.end() for s in _END.finditer(text))]:
        if at < end or at >= size:
            continue
        c = text[at]
        if c not in "<*[>" and (not c.isalpha() or c.islower() and text[at + 1 : at + 2] != "."):
            continue
        m = _LABEL.match(text, at)
        if not m:
            continue
        end = m.end()
        kind = m.lastgroup if m.lastgroup != "e" else "n"
        label = m.group(kind)
        form = "a"
        if kind == "n":
            mark = _is_mark[label]
            form = kind + m.group("e")
            if form == "n." and mark:
                if len(label) > 1 and not label.isupper() and at:
                    continue
                form = "a"
            elif form == "n." and not _readings[label][2]:
                continue
            elif form == "n—" and (mark or not re.search(r"\b[^\W\d_]\.", label)):
                continue
        elif kind in "kp":
            form = kind
        yield at, end, form, label


def read_segment(text: str | None) -> list[tuple[str | None, str | None, int, int]]:
    """``(form, label, words, words of the label)`` of a segment's stretches; the first has no label.

    Forms: ``n.``, ``n:``, ``n—``, ``k`` (in brackets) and ``p`` (with a note) are labels only if
    they name somebody; ``a`` is one in any case.
    """
    text = text or ""
    if _BRACKET.search(text):
        text = _NOTE.sub(" ", _TIME.sub(" ", text))
    found = list(_labels(text))
    ends = [a for a, _, _, _ in found[1:]] + [len(text)]
    out: list[tuple[str | None, str | None, int, int]] = [(None, None, _words(text[: found[0][0]] if found else text), 0)]
    for (start, end, form, label), stop in zip(found, ends):
        own = _words(text[start:end])
        if start and not text[start - 1].isspace() or end < len(text) and not text[end].isspace():
            # a token reaches over an end of the label: count it once where the label is none
            left, right = start - len(text[:start].split()[-1]) if start and not text[start - 1].isspace() else start, end
            while right < len(text) and not text[right].isspace():
                right += 1
            own = _words(text[left:right]) - _words(text[left:start]) - _words(text[end:right])
        out.append((form, label, _words(text[end:stop]), own))
    return out


def stretches(text: str | None, speaker_name: str | None, roster: Roster) -> list[tuple[str | None, str | None, int]]:
    """``(speaker, odd name, words)`` of the stretches of a segment; (None, None, _) goes on with the last speaker."""
    rows = read_segment(text)
    if speaker_name and speaker_name.strip():
        rows[0] = ("s", speaker_name, *rows[0][2:])
    meant = dict(zip(keys := [(label, form) for form, label, _, _ in rows if label is not None], roster.resolve(keys)))
    out: list[tuple[str | None, str | None, int]] = []
    for form, label, n, own in rows:
        taken, speaker, odd = meant.get((label, form), (True, None, None))
        if taken:
            out.append((speaker, odd, n))
        else:
            out[-1] = (*out[-1][:2], out[-1][2] + own + n)
    return out


def assign(costs: list[list[float]]) -> list[int]:
    """Least-cost assignment of rows to distinct columns (at least as many columns as rows)."""
    n, m = len(costs), len(costs[0]) if costs else 0
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = costs[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def place_odd(odd: list[str], elsewhere: list[str | None], people: list[str], named: list[str]) -> list[str]:
    """Speakers of a document's odd names: persons of the roster nobody named, by least total
    distance; else the spelling of other headers; else the name itself."""
    free = [p for p in dict.fromkeys(people) if p not in set(named)]
    far = 0.5  # beyond this share of the letters a person is not meant
    costs = []
    for name, other in zip(odd, elsewhere):
        row = [min(edits(name, plain(p), 99), edits(sound(name), sound(plain(p)), 99) + 0.5) / max(len(p), len(name), 1) for p in free]
        # a column of its own for staying unplaced; cheaper if other transcripts know the name
        costs.append(row + [far if other is None else 0.3] * len(odd))
    if not costs:
        return []
    return [free[j] if j < len(free) else (other or name) for j, name, other in zip(assign(costs), odd, elsewhere)]


_PARTS = "document_id long, segment_index int, part int, form string, label string, n_words int, own_words int"
_SEP = "\x1f"


def _parts(once: DataFrame) -> DataFrame:
    """Stretches of the segments, and the persons of headers (form ``h``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, i, name, kind, text in zip(*(c.to_pylist() for c in b.columns)):
                if kind == "header":
                    rows += [(d, i, k, "h", _SEP.join(p), 0, 0) for k, p in enumerate(read_header(text))]
                else:
                    each = read_segment(text)
                    if name and name.strip():
                        each[0] = ("s", name, *each[0][2:])
                    rows += [(d, i, k, *part) for k, part in enumerate(each)]
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["document_id", "segment_index", "part", "form", "label", "n_words", "own_words"])

    return once.select("document_id", "segment_index", "speaker_name", "segment_type", "text").mapInArrow(run, _PARTS)


def _persons(people: list | None) -> list[tuple[str, str, str]]:
    return [tuple(p.split(_SEP)) for p in people] if people is not None else []


def speaker_turns(segments: DataFrame) -> DataFrame:
    """``document_id, turn_no, speaker, n_words`` of ``document_id, segment_index, speaker_name, segment_type, text`` (and ``created_at, id`` where present)."""
    spark = segments.sparkSession
    order = [F.col(c) for c in ("created_at", "id") if c in segments.columns] or [F.lit(0)]
    row = F.struct(*order, "speaker_name", "segment_type", "text")
    # few bytes but much work each: as many tasks as there are cores at least
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    once = (
        segments.filter("document_id is not null and segment_index is not null")
        .select(F.col("document_id").cast("long").alias("document_id"), F.col("segment_index").cast("int").alias("segment_index"), row.alias("row"))
        .repartition(tasks, "document_id", "segment_index")
        .groupBy("document_id", "segment_index").agg(F.min("row").alias("row"))
        .select("document_id", "segment_index", "row.speaker_name", "row.segment_type", "row.text")
        .filter("segment_type is null or segment_type <> 'footer'")
    )
    parts = materialize(_parts(once), "parts")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("segment_index", "part", "label"))), lambda p: p["label"])
    rosters = parts.filter("form = 'h'").groupBy("document_id").agg(in_order.alias("people"))
    asked = parts.filter("form <> 'h' and label is not null").groupBy("document_id").agg(F.collect_set(F.struct("label", "form")).alias("asked"))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, asked, people in zip(b["document_id"], b["asked"], b["people"]):
                labels = sorted((a["label"], a["form"]) for a in asked)
                rows += [(d, *one, *found) for one, found in zip(labels, Roster(_persons(people)).resolve(labels))]
            yield pd.DataFrame(rows, columns=["document_id", "label", "form", "taken", "speaker", "odd"])

    met = asked.join(rosters, "document_id", "left").select("document_id", "asked", "people")
    labels = materialize(met.mapInPandas(resolve, "document_id long, label string, form string, taken boolean, speaker string, odd string"), "labels")
    # odd names, by sound, against the rosters of all transcripts
    odd = labels.filter("speaker is null and odd is not null").select("document_id", "odd").distinct()
    by_sound = F.pandas_udf(lambda s: s.map(lambda x: sound(plain(x))), "string")
    spelled = parts.filter("form = 'h'").select(F.split("label", _SEP)[0].alias("family")).groupBy("family").count()
    known = spelled.withColumn("sound", by_sound("family")).groupBy("sound").agg(F.max_by("family", F.struct("count", "family")).alias("elsewhere"))
    unmet = odd.withColumn("sound", by_sound("odd")).join(known, "sound", "left")
    named = labels.filter("speaker is not null").groupBy("document_id").agg(F.collect_set("speaker").alias("named"))
    cases = unmet.groupBy("document_id").agg(F.collect_list(F.struct("odd", "elsewhere")).alias("odd")).join(rosters, "document_id", "left").join(named, "document_id", "left")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, odds, people, own in zip(b["document_id"], b["odd"], b["people"], b["named"]):
                odds = sorted(((o["odd"], o["elsewhere"]) for o in odds), key=lambda o: o[0])
                names = [o for o, _ in odds]
                who = place_odd(names, [e for _, e in odds], [p[0] for p in _persons(people)], list(own) if own is not None else [])
                rows += [(d, o, w) for o, w in zip(names, who)]
            yield pd.DataFrame(rows, columns=["document_id", "odd", "placed"])

    placed = cases.select("document_id", "odd", "people", "named").mapInPandas(place, "document_id long, odd string, placed string")
    # one row a document, so that the join and the windows after it share one shuffle
    entry = F.struct(F.concat_ws(_SEP, "form", "label"), F.struct("taken", F.coalesce("speaker", "placed").alias("speaker")))
    meant = labels.join(placed, ["document_id", "odd"], "left").groupBy("document_id").agg(F.map_from_entries(F.collect_list(entry)).alias("meant"))
    found = F.when(F.col("label").isNotNull(), F.col("meant")[F.concat_ws(_SEP, "form", "label")])
    none = F.col("label").isNotNull() & ~F.col("found.taken")
    told = (
        parts.filter("form is null or form <> 'h'").join(meant, "document_id", "left").withColumn("found", found)
        .select("document_id", "segment_index", "part", F.col("found.speaker").alias("said"), F.when(none, F.col("n_words") + F.col("own_words")).otherwise(F.col("n_words")).alias("n_words"))
    )
    by_place = Window.partitionBy("document_id").orderBy("segment_index", "part")
    going_on = by_place.rowsBetween(Window.unboundedPreceding, 0)
    spoke = told.withColumn("speaker", F.last("said", ignorenulls=True).over(going_on)).filter("n_words > 0")
    changed = (~F.col("speaker").eqNullSafe(F.lag("speaker").over(by_place)) | F.lag("n_words").over(by_place).isNull()).cast("int")
    turned = spoke.withColumn("new", changed).withColumn("turn_no", F.sum("new").over(going_on).cast("int"))
    return turned.groupBy("document_id", "turn_no").agg(F.first("speaker").alias("speaker"), F.sum("n_words").cast("int").alias("n_words")).select("document_id", "turn_no", "speaker", "n_words")

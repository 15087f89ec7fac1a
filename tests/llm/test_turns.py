"""Speaker turns: labels, marks, sounds, repeats and odd names."""

import itertools

import pytest

from chronolex.llm import turns

SCHEMA = "id long, document_id long, segment_index int, speaker_name string, segment_type string, text string, created_at timestamp, turn_no int"


def table(spark, rows):
    return spark.createDataFrame([(i, *r, None, None) for i, r in enumerate(rows)], SCHEMA).repartition(3)


def of(spark, rows):
    return [tuple(r) for r in turns.speaker_turns(table(spark, rows)).orderBy("document_id", "turn_no").select("document_id", "turn_no", "speaker", "n_words").collect()]


HEAD = (1, 0, None, "header", "Speakers — William Delwivick, Vice Chair; Odalys Naxmiwick, Moderator; Renée Marnitz (press)")


def test_turns_of_a_transcript(spark):
    rows = [
        HEAD,
        (1, 1, None, "header", "Transcript of the discussion held in Amberley, recording 3"),
        (1, 2, "William Delwivick", "body", "ODALYS NAXMIWICK: Truckers report, mm, that [door closes] funding matters."),  # 5
        (1, 3, "William Delwivick", "body", "<00:14:58.037> VICE CHAIR DELWIVICK. Before um... the years -- erm -- it (see chart 2) lagged."),  # 8
        (1, 3, "William Delwivick", "body", "<00:14:58.037> VICE CHAIR DELWIVICK. Before um... the years -- erm -- it (see chart 2) lagged."),
        (1, 4, None, "answer", "[31:17 --> 31:46] And so it goes on."),  # 5
        (1, 5, None, "unknown", "{applause}"),
        (1, 7, None, "question", "Q: How worried [last year's] are you? A: Not very, very much."),  # 6, 4
        (1, 8, "Renee Marnitz", "question", "Could you say more?"),  # 4
        (1, 9, None, "answer", "THE MODERATOR: Please.\nW. Delwivick — Yes (at 10:30 this morning)."),  # 1, 5
        (1, 10, "William Delwivick", "footer", "END OF TRANSCRIPT"),
    ]
    assert of(spark, rows) == [
        (1, 1, "naxmiwick", 5), (1, 2, "delwivick", 13), (1, 3, "question", 6), (1, 4, "delwivick", 4), (1, 5, "marnitz", 4), (1, 6, "naxmiwick", 1), (1, 7, "delwivick", 5),
    ]


@pytest.mark.parametrize("label", ["<v Renée Marnitz>", "**Renée Marnitz:**", "[Marnitz]", ">> MARNITZ:", "Marnitz (Ms.):", "R. Marnitz —", "MS. MARNITZ.", "Ms. Marnitz:", "MARNITZ:", "Renée Marnitz:", "Renee Marnits:"])
def test_forms_of_a_label(label):
    roster = turns.Roster(turns.read_header(HEAD[4]))
    (before, _, zero), (speaker, odd, words) = turns.stretches(f"[00:01:02] {label} [00:01:03] Two words", None, roster)
    assert (before, zero, speaker, odd, words) == (None, 0, "marnitz", None, 2)


def test_what_is_no_label():
    roster = turns.Roster(turns.read_header(HEAD[4]))
    for text in ("Compare output with growth: the first grew.", "A reading of 5 percent.", "In the weeks after March. Marnitz said so.", "That (in real terms) is um so"):
        assert len(turns.stretches(text, "William Delwivick", roster)) == 1


def test_edge_cases(spark):
    rows = [(2, 0, None, None, None), (2, 1, None, "body", ""), (2, 2, "", "body", "no name yet"), (2, 3, "Somebody Else", "body", "a word"), (None, 1, "X Y", "body", "lost"), (3, None, "X Y", "body", "lost")]
    assert of(spark, rows) == [(2, 1, None, 3), (2, 2, "else", 2)]
    assert turns.speaker_turns(table(spark, rows).limit(0)).count() == 0


def test_odd_names_are_assigned_to_unnamed_persons(spark):
    rows = [
        (4, 0, None, "header", "Present: Ilse Krowikov, Governor; Priya Skecronor, Moderator"), (4, 1, None, "body", "KROWIKOV: One."), (4, 2, None, "body", "MODERATOR SKEKRONNORS: Two words."),
        (5, 0, None, "header", "Present: Ilse Wexhutan, Chair"), (5, 1, None, "body", "MR. KROWIKOFF: Three little words."),
    ]
    assert of(spark, rows) == [(4, 1, "krowikov", 1), (4, 2, "skecronor", 2), (5, 1, "krowikoff", 3)]


def test_labels_are_placed_together():
    roster = turns.Roster([("Karwick".lower(), "", ""), ("karwack", "", ""), ("delwivick", "", "chair")])
    # one edit from two persons: the one whom no other label names
    assert roster.place(["karwick", "karwuck"]) == {"karwick": "karwick", "karwuck": "karwack"}
    assert roster.place(["karwack", "karwuck"]) == {"karwack": "karwack", "karwuck": "karwick"}
    # several spellings of one person, and names of nobody
    assert roster.place(["delwivick", "dellwivik", "delwivck", "somebody"]) == {"delwivick": "delwivick", "dellwivik": "delwivick", "delwivck": "delwivick"}
    assert roster.resolve([("THE CHAIR", "n:"), ("Karwuck", "n:"), ("laughter", "k"), ("Compare", "n:")]) == [(True, "delwivick", None), (True, "karwick", None), (False, None, None), (False, None, None)]
    assert turns.Roster([]).resolve([("A", "a"), ("MR. NEW", "n:")]) == [(True, None, None), (True, None, "new")]


def test_words_of_what_is_no_label_count():
    roster = turns.Roster(turns.read_header(HEAD[4]))
    for text in ("So. [last year's] Marnitz (Ms.): two", "End.[some words]glued on", "New Words: here. Delwivick — no", "So. [x y][z w]c"):
        assert [w for _, _, w in turns.stretches(text, None, roster)] == [sum(any(c.isalnum() for c in w) for w in text.split())], text


def test_assignment_is_optimal():
    import random

    rng = random.Random(5)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(4, 5)
        costs = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = turns.assign(costs)
        assert len(set(got)) == n
        assert sum(costs[i][j] for i, j in enumerate(got)) == min(sum(costs[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))

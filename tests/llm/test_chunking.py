from random import Random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.chunking import WORD, paragraphs, pieces, split_oversized

TEXT = " ".join(f"word{i}" + ("." if i % 17 == 0 else "," if i % 5 == 0 else "") for i in range(2000))


def check(text, limit, overlap, unit):
    got = pieces(text, limit, overlap, unit)
    if len(got) < 2:
        return got
    overlap = max(0, min(overlap, limit - 1))
    units = list(range(len(text))) if unit == "chars" else [m.span() for m in WORD.finditer(text)]
    at = 0
    for k, (i, a, b, n, kind, piece) in enumerate(got):
        assert i == k and piece == text[a:b] and n <= limit
        assert n == (len(piece) if unit == "chars" else len(WORD.findall(piece)))
        start = at if k == 0 else at - overlap
        assert a == (units[start] if unit == "chars" else units[start][0])
        at = start + n
    assert at == len(units) and got[-1][4] == "end"
    return got


def test_sizes_overlaps_and_coverage():
    rng = Random(1)
    for _ in range(60):
        n = rng.randint(1, 1500)
        text = " ".join(rng.choice(["a", "bb.", "ccc,", "日本語。", "d\n", "e\xa0f"]) for _ in range(n))
        check(text, rng.randint(2, 300), rng.randint(0, 100), rng.choice(["words", "chars"]))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(1, 60), st.integers(0, 70), st.sampled_from(["words", "chars", None]))
def test_any_text(text, limit, overlap, unit):
    check(text, limit, overlap, unit)


def test_cuts_stand_at_sentence_ends():
    assert {p[4] for p in check(TEXT, 256, 50, "words")} == {"sentence", "end"}
    assert {p[4] for p in check(TEXT, 900, 150, "chars")} == {"sentence", "end"}
    assert {p[4] for p in check("x" * 5000, 900, 0, "chars")} == {"hard", "end"}
    assert {p[4] for p in check("x " * 5000, 900, 0, "words")} == {"word", "end"}


def test_an_edit_alters_neighbouring_pieces_only():
    before, after = pieces(TEXT, 256, 50, "words"), pieces(TEXT.replace("word700", "word700 inserted"), 256, 50, "words")
    same = {p[5] for p in before} & {p[5] for p in after}
    assert len(before) - len(same) <= 4


def test_cases():
    assert pieces(None, 5, 1, "words") == [] and pieces("", 5, 1, "words")[0][3] == 0
    assert len(pieces("a b c", None, 1, "words")) == len(pieces("a b c", 0, 1, "words")) == 1
    assert len(pieces("a b c d", 2, 9, "words")) == 3  # the overlap counts as the limit less 1
    assert len(pieces("word " * 300_000, 256, 50, "words")) > 1000


def test_frame(spark, data):
    schema = "row_id long, source string, pre_text array<string>, post_text array<string>, text string, chunk_size int"
    ex = spark.createDataFrame([(1, "s", ["a b c d", None, "a"], None, "x", 1), (2, None, ["aaaa bb"], ["a b c"], "x", 1), (3, "t", None, [], "x", 1)], schema)
    cfg = spark.createDataFrame([(1, "default", 2, 0, "words"), (2, "s", 3, 1, "words"), (3, "s", 1, 0, "words"), (4, "t", None, None, None)], "config_id int, source string, chunk_size int, chunk_overlap int, size_unit string")
    got = split_oversized(paragraphs(ex, cfg), ["row_id", "side", "para_idx"]).orderBy("row_id", "piece_idx").collect()
    assert {(r.row_id, r.side, r.para_idx) for r in got} == {(1, "pre", 0), (2, "post", 0)}
    first, last = [r for r in got if r.row_id == 1]
    assert first.units <= 3 and last.piece.endswith("c d") and first.piece.split()[-1] == last.piece.split()[0]
    assert [r.piece for r in got if r.row_id == 2] == ["a", "b c"] or [r.piece for r in got if r.row_id == 2] == ["a b", "c"]
    assert split_oversized(paragraphs(ex.limit(0), cfg), ["row_id"]).count() == 0
    assert paragraphs(ex, cfg.filter("source = 's'")).filter("row_id = 2 and chunk_size is null").count() == 2

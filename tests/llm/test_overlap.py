from collections import Counter
from random import Random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import overlap as O
from tallyforge.llm.overlap import agree, banded_distance, cross_split_overlaps, distance, field_words, overlap_classes, overlap_counts, words


def common(a, b):
    return sum((Counter(a) & Counter(b)).values())


def dice(a, b):
    n = len(a) + len(b)
    return 1.0 if n == 0 else 2 * sum((Counter(a) & Counter(b)).values()) / n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=30), st.lists(st.sampled_from("abcdefg"), max_size=30))
def test_distance_of_canonical_strings_is_agreement(a, b):
    a, b = sorted(a), sorted(b)
    d = len(a) + len(b) - 2 * common(a, b)
    assert banded_distance(a, b, len(a) + len(b)) == d
    assert banded_distance(a, b, d) == d and (d == 0 or banded_distance(a, b, d - 1) is None)
    assert distance(a, b, d) == d and (d == 0 or distance(a, b, d - 1) is None)
    assert agree(a, b) == (dice(a, b) >= 0.75)


def test_distance_of_any_strings():
    rng = Random(6)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = before[j - 1] if x == y else 1 + min(before[j], row[j - 1])
        for k in range(25):
            assert banded_distance(a, b, k) == (row[-1] if row[-1] <= k else None)


def test_long_fields_take_linear_time():
    a = sorted(f"w{i}" for i in range(100_000))
    b = sorted([f"w{i}" for i in range(75_000)] + [f"v{i}" for i in range(25_000)])
    assert agree(a, b) and not agree(a, b, 0.76) and agree(["x"] * 100_000, ["x"] * 60_000)


def test_segments_lose_no_pair():
    """Every agreeing pair of strings in one order has a first common word within its segments, at an allowed position."""
    rng = Random(12)
    for _ in range(5000):
        a, b = (sorted(rng.sample(range(40), rng.randint(1, 30))) for _ in range(2))
        n, m, both = len(a), len(b), set(a) & set(b)
        if 2 * len(both) >= 0.75 * (n + m):
            p, q = a.index(min(both)), b.index(min(both))
            assert p < int(0.4 * n + 1e-9) + 1 and q < int(0.4 * m + 1e-9) + 1 and p + q + abs((n - p) - (m - q)) <= 0.25 * (n + m)

def test_words():
    assert words("Net Sales: $1,234.5 (FY2019)") == ["net", "sales", "1234", "5", "fy2019"]
    assert field_words([["a", None], None, ["b c"]]) == ["a", "b", "c"] and field_words(None) == [] and field_words(["x", None]) == ["x"]
    assert words("über_maß ½") [:2] == ["über", "maß"]


SCHEMA = "row_id long, split string, source string, question string, table_cells array<array<string>>, pre_text array<string>, train boolean, page string"


def brute(rows):
    out = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] in ("dev", "test") and all(dice(field_words(a[i]), field_words(b[i])) >= 0.75 for i in (3, 4, 5)):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_against_brute_force(spark):
    rng = Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + [str(rng.randint(1000, 99_999_999)) for _ in range(300)]
    pages = [([[rng.choice(vocabulary) for _ in range(4)] for _ in range(rng.randint(1, 6))], [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40))) for _ in range(rng.randint(0, 4))]) for _ in range(40)]
    questions = ["what was net sales in 2019?", "what was net sales in 2019", "why did total debt change in 2020?", "", None, "What was Net Sales in 2018?"]

    def edit(words_of, p):
        return [w for x in words_of for w in ([x] if rng.random() > p else [rng.choice(vocabulary)] if rng.random() < 0.5 else [])]

    rows = []
    for i in range(260):
        t, p = rng.choice(pages)
        noise = rng.choice([0, 0, 0.03, 0.1, 0.2])
        t2 = [edit(r, noise) for r in t]
        p2 = [" ".join(edit(x.split(), noise)) for x in p]
        rng.shuffle(p2)
        rows.append((i, rng.choice(["train", "train", "dev", "test", None]), "s", rng.choice(questions), rng.choice([t2, t2, t2, None]), rng.choice([p2, p2, None, []]), None, "x"))
    got = cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(set(got))
    want, found = brute(rows), {tuple(r) for r in got}
    assert found == want and len(want) > 100


def test_copies_and_many_questions_of_a_page(spark):
    page = ([["a", "1234567"]], ["same text 7654321"])
    rows = [(i, "train" if i % 2 else "dev", "s", f"question number {i % 40} about item{i % 40} of the long list", *page, None, "x") for i in range(400)]
    rows += [(1000 + i, "train" if i % 2 else "test", None, None, None, None, None, None) for i in range(20)]
    got = {tuple(r) for r in cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_and_counts(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cross_split_overlaps(none).count() == 0
    rows = spark.createDataFrame([(1, "dev", "s", "q one", [["a"]], ["b"], None, "x"), (2, "train", "s", "q one", [["a"]], ["b"], None, "x"), (3, "dev", "s", "other", None, None, None, "x")], SCHEMA)
    assert [tuple(r) for r in cross_split_overlaps(rows).collect()] == [(1, 2)]
    assert [tuple(r) for r in overlap_counts(rows).collect()] == [("dev", "s", 2, 1, 1)]


def test_outline_never_overstates(spark):
    rng = Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 300))] for _ in range(2))
        outline = sum(abs(x - y) for x, y in zip(O.outline(Counter(a)), O.outline(Counter(b))))
        assert outline <= len(a) + len(b) - 2 * common(a, b)


def near_copies(rng, n, questions):
    """Copies of one page, each with own numbers: what they share stands in all, the rare words in one each."""
    labels = [f"label{i}" for i in range(30)]
    text = [f"common{i}" for i in range(60)]
    rows = []
    for i in range(n):
        own = [str(rng.randint(10**6, 10**9)) for _ in range(10)]
        rows.append((i, "train" if i % 2 else "dev", "s", rng.choice(questions), [[w] for w in labels + own[:6]], [" ".join(text + own)], None, "x"))
    return rows


def test_many_near_copies_with_own_words(spark):
    rows = near_copies(Random(7), 160, ["what was net sales in 2019?"])
    rows += [(1000 + i, "train" if i % 2 else "test", "s", "why?", None, [f"boilerplate text of every filing in the year {i} a b c d e f"], None, "x") for i in range(120)]
    got = [tuple(r) for r in cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) and len(got) == 80 * 80 + 60 * 60


def test_random_pages_are_found_whole(spark):
    rng = Random(11)
    rows = []
    for i in range(300):  # few words, so that pages agree by chance at every size, with repetitions
        t = [[rng.choice("abcdef") for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 3))]
        rows.append((i, rng.choice(["train", "dev"]), "s", "q", t, [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 6)))], None, "x"))
    want = brute(rows)
    assert {tuple(r) for r in cross_split_overlaps(spark.createDataFrame(rows, SCHEMA)).collect()} == want and len(want) > 100


def test_hot_words_are_salted(spark):
    rows = near_copies(Random(8), 60, ["q"])
    df = spark.createDataFrame(rows, SCHEMA)
    pages = O.outlines(df).selectExpr("row_id AS pid", "train", "not train AS eval", "nt", "np", "ot", "op", "once", "twice", "tokens")
    got = [tuple(r) for r in O.page_pairs(pages, df, hot=7).collect()]
    assert len(got) == len(set(got)) == 30 * 30
    assert sorted(got) == sorted(tuple(r) for r in O.page_pairs(pages, df).collect())


def test_fingerprint_never_overstates():
    rng = Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(0, 80))] for _ in range(2))
        x, y = O.fingerprint(Counter(a)), O.fingerprint(Counter(b))
        assert sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x, y)) <= len(a) + len(b) - 2 * common(a, b)


def test_changed_numbers_beyond_any_head(spark):
    rows = []
    for i, split in enumerate(("dev", "train")):
        own = [str(10**6 * (i + 1) + j) for j in range(14)]
        words_of = [f"common{j}" for j in range(50)]
        rows.append((i, split, "s", "q", [[w] for w in words_of + own], [" ".join(words_of + own)], None, "x"))
    filler = [(100 + i, "train" if i % 3 else "dev", "s", "q", [[f"common{j}"] for j in range(i % 50)], [" ".join(f"common{j}" for j in range(50))], None, "x") for i in range(150)]
    assert {tuple(r) for r in cross_split_overlaps(spark.createDataFrame(rows + filler, SCHEMA)).collect()} == brute(rows + filler) >= {(0, 1)}


def test_copies_are_classes_and_written_out_in_pieces(spark):
    rows = [(i, "train" if i % 3 else "dev", "s", "what was net sales?", [["a", "7"]], ["b"], None, "x") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    similar, members = overlap_classes(df)
    assert similar.collect() == [(0, 1)] and members.count() == 300
    got = [tuple(r) for r in cross_split_overlaps(df, copies=30).collect()]
    assert len(got) == len(set(got)) == 100 * 200
    assert [tuple(r) for r in overlap_counts(df).collect()] == [("dev", "s", 100, 100, 20_000)]

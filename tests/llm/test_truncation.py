from random import Random

from tallyforge.llm.truncation import kinds, line_state, lines_of, sketch, still_open, tail, truncated, truncation_rates

WHOLE = ["Net sales rose 4.1% in 2019.", "Why?", "管理层预计需求将逐步恢复。", "They fell (see schedule 5).", "| a | b |\n|---|---|\n| 1 | 2 |", "Sold for $5.\n— — —", "Done.\n👍", '{"form": "A-1", "ok": true}', "See note.<br/>\n", "Ende.​", "ends here.\n[End of transcript]"]
CUT = {"Net sales rose 4.1% in 20": "open", "Net sales…": "marked", "Net sales rose in the...": "marked", "the year [...]": "marked", "负债�": "broken", "| a | b |\n|---|---|\n| inventories | 5": "row", "| a | b |\n| 1 |": "row", "They fell &am": "broken", "ends with \\u20": "broken"}


def test_states():
    for t in WHOLE:
        assert tail(lines_of(t))[0][1] == "complete", t
    for t, state in CUT.items():
        assert tail(lines_of(t))[0][1] == state, t
    assert tail([]) == tail(lines_of("")) == tail(lines_of(" \n​\xa0")) == []
    assert still_open("a (b [c] d") == ["("] and still_open("1) a") == []
    assert lines_of("a<br/>b\r\n\n c\xa0") == ["a", "b", "c"] and line_state(["â€” â€”"], 0) == "complete"
    assert len(tail(["word " * 200_000 + "."])) == 1
    for long in ("a" + " " * 300_000 + "b", "x" * 300_000, "�" * 300_000, '"' * 300_000 + "a", "a@" * 150_000):
        assert tail([long])[0][1] != "complete", long[:3]
    assert len(still_open("(" * 300_000 + "a.")) == 300_000 and still_open("<" * 300_000) == []


def corpus():
    rng = Random(4)
    rows = []
    for i in range(400):
        body = "\n".join(" ".join(rng.choice(["sales", "rose", "by", "5%", "in", "2019"]) for _ in range(12)) + f" item {i}." for _ in range(3))
        end = rng.choice(["\nEND OF CALL", "\nSee accompanying notes", "\nMedia line: press@x%d.example" % i, ""])
        cut = i % 10 == 0
        rows.append((i, "s" if i % 3 else None, (body[: len(body) - rng.randint(8, 30)] + rng.choice(["", " ", "…", " [...]"]) if cut else body + end), cut))
    return rows


def test_planted_cuts_and_rates(spark):
    rows = corpus()
    rows += [(1000 + i, "t", "the same cut text stops in the mid", True) for i in range(50)]  # copies don't make a closing line
    rows += [(2000, "s", None, False), (2001, "s", "", False), (2002, None, " \n ", False)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c, _ in rows], "doc_id long, source string, text string, state string")
    assert {r.doc_id for r in truncated(df).collect()} == {r[0] for r in rows if r[3]}
    rates = {r.source: (r.texts, r.cut) for r in truncation_rates(df).collect()}
    assert rates["t"] == (50, 50) and sum(c for _, c in rates.values()) == 90 and sum(t for t, _ in rates.values()) == 450
    assert truncated(df.limit(0)).count() == 0 and truncated(df.union(df)).count() == 90


def test_tables_ends(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    n, cut = d.count(), truncated(d).count()
    assert 0 < cut < 0.2 * n


def pages(n, source, end, start=0):
    """Texts that have nothing in common but their end."""
    rng = Random(9 + start)
    return [(start + i, source, " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(40)) + f" whole {i}." + end) for i in range(n)]


def found(spark, rows):
    return {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}


def test_near_copies_cut_at_one_place(spark):
    names = ["Tarn", "Holt", "Mirel", "Oska", "Brandt", "Quill"]
    one = "The board of %s plc met on day %d of the month to look at the accounts of all units and found them in order.\nThe notes are carried at"
    two = "%s Group gave the rate as %d and said that no change of policy was planned by those who lead the units in the"
    rows = [(i, "s", (one if i < 60 else two) % (names[i % 6] + chr(97 + i % 26), i)) for i in range(120)]
    closed = pages(60, "s", "\nEND OF CALL", 1000)
    assert found(spark, rows + closed) == set(range(120))


def test_wrapped_lines_and_other_sources(spark):
    wrapped = pages(40, "s", "\nForward-looking statements are\nsubject to risks that could change what the", 100)
    whole = pages(60, "s", "\nForward-looking statements are\nsubject to risks that could change what the\ngroup expects of the year to come.", 200)
    first = pages(20, "s", "\nForward-looking statements are", 300)
    small = pages(2, "t", "\nas stated in the", 400)
    here = pages(50, "u", "\nEND OF CALL", 500)
    copy, unnamed = [(700, "w", here[0][2])], pages(1, None, "\nEND OF CALL", 800)
    other = pages(2, "v", "\nas stated in the", 900)[:1]
    got = found(spark, wrapped + whole + first + small + here + copy + unnamed + other + pages(10, "v", "", 2000))
    assert got >= {r[0] for r in wrapped + first + other} and not got & {r[0] for r in whole + here + copy + unnamed}


def test_two_different_texts_show_a_closing_line(spark):
    for start in range(0, 60, 2):
        assert kinds([sketch(t) for _, _, t in pages(2, "s", "\nthat is all", start)], 2) == 2
    rows = [(100 * k + i, f"s{k}", t) for k in range(80) for i, _, t in pages(2, "", "\nthat is all", 1000 + 2 * k)]
    assert found(spark, [(n, s, t) for n, (_, s, t) in enumerate(rows)]) == set()


def test_what_is_still_open():
    for t in ("See (the next\npage).", 'She said "rose" and "fell".', "<div>a<br><p>b</div>.", 'A 19" screen.', r'{"a": "b\"c"}', "a) b) c", "x < y > z", "<redacted> it rose.", "「a」。"):
        assert still_open(t) == [], t
    for t, kind in {"He said (see the\nnext page for the rest.": "(", 'She said "revenue rose.': '"', "<div>Revenue <b>rose</b>.": "<div>", "“They rose.": "“", "([a).": None, "「売上。": "「"}.items():
        assert still_open(t) == ([kind] if kind else []), t


def test_unclosed_texts_are_cut_unless_their_source_leaves_them_open(spark):
    rows = pages(100, "s", "") + [(200, "s", "He said (see the\nnext page for the rest."), (201, "s", 'Why.\nShe said "revenue rose.'), (202, "s", "<div>Revenue rose.")]
    manner = [(300 + i, "m", t[2] + "\n[As filed.") for i, t in enumerate(pages(40, "m", "", 5000))]
    assert found(spark, rows + manner) == {200, 201, 202}


def test_long_closing_lines_are_known(spark):
    end = "\nThe statements above are those of the speakers alone and the company takes on no duty to bring them up to date at any later time"
    assert len(end) > 100 and found(spark, pages(60, "s", end)) == set()

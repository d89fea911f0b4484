"""Pieces of DuckDB SQL that the checking queries share; written apart from the Spark expressions they check."""

from __future__ import annotations

FLOAT = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

#: Body cells of every table: row_id, row_idx, col_idx, header, label, raw.
CELLS = r"""
trows AS (SELECT row_id, unnest(range(len(table_cells))) AS row_idx, unnest(table_cells) AS r FROM finqa_examples WHERE table_cells IS NOT NULL),
heads AS (SELECT row_id, list_transform(r, lambda h: trim(replace(coalesce(h, ''), chr(160), ' '))) AS head FROM trows WHERE row_idx = 0),
cells AS (
    SELECT x.row_id, CAST(x.row_idx AS INTEGER) AS row_idx, CAST(x.col_idx AS INTEGER) AS col_idx,
           coalesce(h.head[x.col_idx + 1], '') AS header, lower(trim(replace(coalesce(x.r[1], ''), chr(160), ' '))) AS label,
           trim(replace(coalesce(x.cell, ''), chr(160), ' ')) AS raw
    FROM (SELECT row_id, row_idx, r, unnest(range(len(r))) AS col_idx, unnest(r) AS cell FROM trows WHERE row_idx > 0) x
    LEFT JOIN heads h USING (row_id))
"""


def number(x: str) -> str:
    core = rf"regexp_replace(regexp_replace(trim(replace({x}, chr(160), ' ')), '[$, ]', '', 'g'), '^\((.*)\)$', '-\1')"
    return f"(TRY_CAST(nullif(regexp_extract({core}, '^({FLOAT})%?$', 1), '') AS DOUBLE) / CASE WHEN suffix({core}, '%') THEN 100.0 ELSE 1.0 END)"


def financial(x: str) -> str:
    plain = f"trim(regexp_replace(trim(replace({x}, chr(160), ' ')), '[$€£¥,]', '', 'g'))"
    once = rf"regexp_replace({plain}, '^(-?\s*[0-9.]+%?)\s*\(\s*[0-9.]+\s*%?\s*\)$', '\1')"
    core = rf"regexp_replace(replace({once}, ' ', ''), '^\((.*)\)$', '-\1')"
    pat = f"'^({FLOAT})([kKmMbBtT]?)%?$'"
    return (
        f"(TRY_CAST(nullif(regexp_extract({core}, {pat}, 1), '') AS DOUBLE) * CASE lower(regexp_extract({core}, {pat}, 2)) "
        "WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 't' THEN 1e12 ELSE 1.0 END)"
    )


def cell_type(v: str) -> str:
    bare = f"translate({v}, ',$()', '')"
    num = r"'^[\s($]*-?[0-9][0-9,]*\.?[0-9]*\s*[)%]?\s*$'"
    return rf"""CASE WHEN {v} IN ('', '-', '—', 'n/a', 'N/A', 'nan', 'None') THEN 'empty'
        WHEN regexp_matches({v}, '^\s*[$€£¥]') THEN 'currency'
        WHEN regexp_matches({v}, '[0-9]+\.?[0-9]*\s*%') THEN 'percentage'
        WHEN regexp_matches({v}, '\b(19|20)[0-9][0-9]\b|Q[1-4]|FY[0-9][0-9]') AND NOT regexp_matches(replace({v}, ',', ''), {num}) THEN 'date'
        WHEN regexp_matches({bare}, {num}) THEN 'numeric' ELSE 'text' END"""


def plain_float(x: str) -> str:
    return rf"TRY_CAST(nullif(regexp_extract({x}, '^\s*({FLOAT})\s*$', 1), '') AS DOUBLE)"


def normalize(x: str) -> str:
    return f"trim(translate(lower(trim(coalesce({x}, ''))), '%$,', ''))"


def match(p: str, g: str) -> str:
    """Answers that match, from normalised texts in columns ``p`` and ``g``."""
    a, b = plain_float(p), plain_float(g)
    return f"""CASE WHEN {p} = {g} THEN true
        WHEN {a} IS NOT NULL AND {b} = 0 THEN abs({a}) < 0.01
        WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN abs({a} - {b}) / greatest(abs({b}), 1e-10) < 0.01
            OR ({a} <> 0 AND (abs({a} / {b} - 100) / 100 < 0.01 OR abs({a} / {b} - 0.01) / 0.01 < 0.01))
            OR abs(abs({a}) - abs({b})) / greatest(abs({b}), 1e-10) < 0.01
        WHEN {p} IN ('yes', 'true') THEN {g} IN ('yes', 'true')
        WHEN {p} IN ('no', 'false') THEN {g} IN ('no', 'false') ELSE false END"""


YEARS = r"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '\b((?:19|20)[0-9][0-9])\b', 1), lambda y: CAST(y AS INTEGER))))"


def years(x: str) -> str:
    return YEARS.replace("{x}", x)


def keywords(x: str) -> str:
    from tallyforge.functions.expressions import STOPWORDS

    stop = ",".join(f"'{w}'" for w in STOPWORDS)
    plain = rf"regexp_replace(regexp_replace(lower({x}), '\b[0-9][0-9][0-9][0-9]\b', '', 'g'), '\$?[0-9][0-9,.]*%?', '', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({plain}, '\\s+'), lambda w: trim(w, '?.,!;:()')), lambda w: length(w) > 1 AND w NOT IN ({stop}))"


def words3(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z][a-z][a-z]+'))"


def letters(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, '[a-z]+'))"

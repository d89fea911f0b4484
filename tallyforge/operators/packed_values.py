"""Several values packed in one field: a parsing expression grammar that yields one value per row.

Alternatives are ordered: the first that matches holds, and one that fails gives back what it read. With the rule ``calls``
only operations with their arguments are values, and whatever stands between them is noise::

    field    <- (packed / call / noise)*
    packed   <- (json / doubled / python) &closed       a quoted run of fields, parsed by ``field`` again
    call     <- name group
    group    <- '(' (label / group / '[' group* ']' / char)* ')'
    label    <- '"' (!'"' char)* '"'                    plain text: an operation's name in it means nothing

With the rule ``values`` everything is a value::

    field    <- '[' sequence ']' end / sequence
    sequence <- value? (delimiter value?)*
    delimiter<- [;|\t\r\n] / ',' !thousands
    value    <- quoted &(delimiter / end) / call / bracket / bare
    quoted   <- json / doubled / python                 escapes undone
    bracket  <- '(' .. ')' / '[' .. ']' / '{' .. '}'    one value, its brackets kept
    bare     <- (!delimiter char)*                      trimmed

Malformed quotes are backtracked over: what they begin is parsed as a bare value and flagged. A rule that has failed isn't
tried again within what it read, so parsing takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from tallyforge.functions.arrowmap import encodable, flat_map

NAME = re.compile(r"[A-Za-z_]\w*(?=\()")
UNICODE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")  # a run of them, so that the halves of a character meet
JSON_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _call(s: str, at: int) -> int | None:
    """End of the call that begins at ``at``, or None."""
    m = NAME.match(s, at)
    if not m:
        return None
    i, depth, n = m.end(), 0, len(s)
    while i < n:
        c = s[i]
        if c == '"':
            close = s.find('"', i + 1)
            if close < 0:
                return None
            i = close
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return None


def _closed_brackets(s: str, at: int) -> dict[int, int]:
    """Ends of all bracket pairs from ``at`` on, by the place of the opening one: one pass, whatever stays open."""
    ends: dict[int, int] = {}
    stack: list[int] = []
    i, n = at, len(s)
    while i < n:
        c = s[i]
        if c == '"':
            close = s.find('"', i + 1)
            i = close if close >= 0 else i
        elif c in "([":
            stack.append(i)
        elif c in ")]" and stack:
            ends[stack.pop()] = i + 1
        i += 1
    return ends


def _json(s: str, at: int) -> tuple[int, str] | None:
    """A value in double quotes with backslash escapes: its end and its text."""
    if s[at] != '"':
        return None
    out, i, n = [], at + 1, len(s)
    while i < n:
        c = s[i]
        if c == '"':
            return i + 1, "".join(out)
        if c == "\\":
            if i + 1 >= n:
                return None
            e = s[i + 1]
            if e == "u" and (m := UNICODE.match(s, i)):
                out.append(encodable("".join(chr(int(x, 16)) for x in m[0].split("\\u")[1:])))
                i = m.end()
                continue
            out.append(JSON_ESCAPES.get(e, e))
            i += 2
            continue
        out.append(c)
        i += 1
    return None


def _doubled(s: str, at: int) -> tuple[int, str] | None:
    """A value in double quotes in which a quote is written twice."""
    if s[at] != '"':
        return None
    out, i, n = [], at + 1, len(s)
    while i < n:
        if s[i] == '"':
            if i + 1 < n and s[i + 1] == '"':
                out.append('"')
                i += 2
                continue
            return i + 1, "".join(out)
        out.append(s[i])
        i += 1
    return None


def _python(s: str, at: int) -> tuple[int, str] | None:
    """A value in single quotes with backslash escapes."""
    if s[at] != "'":
        return None
    out, i, n = [], at + 1, len(s)
    while i < n:
        c = s[i]
        if c == "'":
            return i + 1, "".join(out)
        if c == "\\" and i + 1 < n:
            out.append(JSON_ESCAPES.get(s[i + 1], s[i + 1]))
            i += 2
            continue
        out.append(c)
        i += 1
    return None


def _closed(s: str, at: int) -> bool:
    """What follows a quoted value: a delimiter, a closing bracket or the end."""
    rest = s[at : at + 64].lstrip()
    return not rest or rest[0] in ",;|]&/>=+-" or not (rest[0].isalnum() or rest[0] in "\"'_(")


def _whole_calls(text: str) -> bool:
    i = 0
    while i < len(text) and text[i].isspace():
        i += 1
    end = _call(text, i) if i < len(text) else None
    return end is not None


def split_packed(field: str | None) -> Iterator[tuple[int, str, str, str | None]]:
    """(position, value, form, error) of every call packed in ``field``.

    ``form`` is bare, json, doubled or python. A call without its closing bracket is one value up to the next call, with
    ``error`` unclosed, and the scan goes on after its name, so later values aren't lost; after a quote without its
    partner, values have ``error`` quote. Null, blank and call-free fields give nothing.
    """
    if not field:
        return
    s, i, pos, n = field, 0, 0, len(field)
    broken_quote, ends = False, None
    refused = {"json": 0, "doubled": 0, "python": 0}  # a rule that failed isn't tried again within what it read
    while i < n:
        c = s[i]
        if c in "\"'":
            for form, rule in (("json", _json), ("doubled", _doubled), ("python", _python)):
                if i < refused[form] or (form == "python") != (c == "'"):
                    continue
                got = rule(s, i)
                refused[form] = got[0] - 1 if got else n
                if got and _closed(s, got[0]) and _whole_calls(got[1]):
                    end, text = got
                    for _, value, _, error in split_packed(text):
                        yield pos, value, form, error
                        pos += 1
                    i = end
                    break
            else:
                broken_quote = broken_quote or c == '"'
                while i + 2 < n and s[i + 1] == s[i + 2] == c:  # of a run of quotes the last may begin a value
                    i += 1
                i += 1
            continue
        if (c.isalpha() or c == "_") and not (i and (s[i - 1].isalnum() or s[i - 1] == "_")) and (m := NAME.match(s, i)):
            end = _call(s, i) if ends is None else ends.get(m.end())
            if end is None and ends is None:
                ends = _closed_brackets(s, i)
                end = ends.get(m.end())
            if end is None:
                after = NAME.search(s, m.end() + 1)
                yield pos, s[i : after.start() if after else n].rstrip(" ,;|\t\r\n"), "bare", "unclosed"
                pos += 1
                i = m.end() + 1
                continue
            yield pos, s[i:end], "bare", "quote" if broken_quote else None
            pos += 1
            i = end
            continue
        i += 1


QUOTED = (("json", _json), ("doubled", _doubled), ("python", _python))
BRACKETS = {"(": ")", "[": "]", "{": "}"}
THOUSANDS = re.compile(r"(?<=\d),(?=\d{3}(?!\d))")


class Values:
    """The rule ``values`` over one field; ``out`` gets (value, form, error) of each value in written order."""

    def __init__(self, s: str) -> None:
        self.s, self.out = s, []
        self.refused = {"json": 0, "doubled": 0, "python": 0}
        self.ends: dict[int, int] = {}
        self.open_from = len(s)  #: from here on all brackets are known: those without an end stay open

    def closing(self, at: int) -> int | None:
        """Place behind the bracket that closes the one at ``at``; what is read on the way is remembered."""
        if at in self.ends or at >= self.open_from:
            return self.ends.get(at)
        s, stack, i = self.s, [at], at + 1
        while i < len(s):
            c = s[i]
            if c == '"' and (close := s.find('"', i + 1)) >= 0:
                i = close
            elif c in BRACKETS:
                stack.append(i)
            elif c == BRACKETS[s[stack[-1]]]:
                self.ends[stack.pop()] = i + 1
                if not stack:
                    return i + 1
            i += 1
        self.open_from = at
        return None

    def field(self) -> None:
        a, b = 0, len(self.s)
        while a < b and self.s[a].isspace():
            a += 1
        while b > a and self.s[b - 1].isspace():
            b -= 1
        if b - a > 1 and self.s[a] == "[" and self.s[b - 1] == "]":
            self.sequence(a + 1, b - 1)
            if not any(error or form == "bare" and any(c in ")]}" for c in value) for value, form, error in self.out):
                return
            self.__init__(self.s)
        self.sequence(a, b)

    def sequence(self, a: int, b: int) -> None:
        """Values from a to b; an empty place between two delimiters is an empty value, one at the end is none."""
        weak = re.search(r"[;|\t\r\n]", self.s[a:b]) is not None  # a comma then may belong to a number
        i = a
        while i < b:
            while i < b and self.s[i] in " \xa0":
                i += 1
            end = self.value(i, b, weak)
            while end < b and self.s[end] in " \xa0":
                end += 1
            i = end + 1
            if self.s[end : end + 2] == "\r\n":
                i += 1
        while self.out and self.out[-1] == ("", "bare", None):
            self.out.pop()

    def delimiter(self, i: int, weak: bool) -> bool:
        c = self.s[i]
        return c in ";|\t\r\n" or c == "," and not (weak and THOUSANDS.match(self.s, i))

    def value(self, i: int, b: int, weak: bool) -> int:
        """Emits the value at i and returns the place of the delimiter behind it, or b."""
        s = self.s
        if i < b and s[i] in "\"'":
            for form, rule in QUOTED:
                if i < self.refused[form] or not (got := rule(s, i)):
                    continue
                end = got[0]
                while end < b and s[end] in " \xa0":
                    end += 1
                if end <= b and (end == b or self.delimiter(end, weak)):
                    self.out.append((got[1], form, None))
                    return end
            for form, _ in QUOTED:
                self.refused[form] = max(self.refused[form], i + 1)
        at, unclosed = i, False
        while at < b and not self.delimiter(at, weak):
            end = self.closing(at) if s[at] in BRACKETS else at + 1
            unclosed = unclosed or end is None
            at = min(end or at + 1, b)
        text = s[i:at].strip()
        error = "quote" if text and text[0] in "\"'" else "unclosed" if unclosed else None
        form = "call" if NAME.match(text) and text.endswith(")") else "bracket" if text[:1] in BRACKETS and error is None else "bare"
        self.out.append((text, form, error))
        return at


def split_values(field: str | None) -> Iterator[tuple[int, str, str, str | None]]:
    """(position, value, form, error) of every value of a field by the rule ``values``.

    ``form`` is json, doubled, python, call, bracket or bare. A value that begins with a quote that isn't closed before a
    delimiter has ``error`` quote, one with a bracket that stays open ``error`` unclosed. Null and blank fields, and empty
    lists, give nothing. Commas between a digit and exactly three digits are part of a number if the field has another
    delimiter too, as in ``1,234; 5``.
    """
    if field and not field.isspace():
        parser = Values(field)
        parser.field()
        for pos, (value, form, error) in enumerate(parser.out):
            yield pos, value, form, error


RULES = {"calls": split_packed, "values": split_values}


def packed_values(df: DataFrame, key: str, field: str, rule: str = "calls") -> DataFrame:
    """One row per packed value: (``key``, pos INT, value, form, error, n_values INT).

    ``rule`` says what a value is: calls (operations with their arguments) or values (quoted, bracketed, call and bare
    values between delimiters). Positions count from 0 in written order. Rows whose field is null, blank or holds no value
    give no rows; repeated rows are each split; other columns of ``df`` don't matter. Escapes that name half a character
    give U+FFFD. One pass without a shuffle: rows are split where they lie.
    """
    split = RULES[rule]

    def make() -> Callable[..., Iterator[tuple]]:
        def each(k: object, s: str | None) -> Iterator[tuple]:
            got = list(split(s))
            for pos, value, form, error in got:
                yield k, pos, value, form, error, len(got)

        return each

    kind = df.schema[key].dataType.simpleString()
    return flat_map(df, [key, field], make, f"`{key}` {kind}, pos int, value string, form string, error string, n_values int")

"""HTML tables of a corpus as cells.

Parsing is local to a row, so nothing is shuffled. Tables without spans take their column from the
position; only tables with spans go through the fold that tracks covered slots.
"""

from __future__ import annotations

import re
from html.entities import html5

from pyspark.sql import DataFrame

CELL = "array<struct<row_no:int,col_no:int,text:string,row_span:int,col_span:int,hidden:boolean>>"


ENTITY = "&#[xX][0-9A-Fa-f]+;|&#[0-9]+;|&[A-Za-z][A-Za-z0-9]{1,31};|&|[^&]+"
UNKNOWN = "\ufffd"


def _quoted(text: str) -> str:
    """A text as an SQL literal of its code units."""
    return "'" + "".join(f"\\u{int.from_bytes(u, 'big'):04x}" for u in re.findall(b"(?s)..", text.encode("utf-16-be"))) + "'"


def _named(name: str) -> str:
    """SQL for the characters of a named reference that ends in a semicolon, by the table of Python's library; null for any other.

    A lookup walks through a map's keys, so the names lie in small maps by their first and second letter.
    """
    shelves: dict[str, list[str]] = {}
    for known, text in sorted(html5.items()):
        if known.endswith(";"):
            shelves.setdefault(known[:2], []).append(f"'&{known}', {_quoted(text)}")
    letters: dict[str, list[str]] = {}
    for head, entries in shelves.items():
        letters.setdefault(head[0], []).append(f"'{head}', map({', '.join(entries)})")
    held = "map(" + ", ".join(f"'{letter}', map({', '.join(inner)})" for letter, inner in letters.items()) + ")"
    return f"try_element_at(try_element_at(try_element_at({held}, substr({name}, 2, 1)), substr({name}, 2, 2)), {name})"


def _numbered(code: str) -> str:
    """SQL for the character of a numeric reference: nothing, surrogates and numbers beyond the last code give U+FFFD, the old Windows codes
    their characters, other control codes and non-characters nothing."""
    old = {}
    for c in range(128, 160):
        try:
            old[c] = bytes([c]).decode("cp1252")
        except UnicodeDecodeError:
            old[c] = chr(c)
    windows = "map(" + ", ".join(f"{c}L, {_quoted(t)}" for c, t in old.items()) + ")"
    return (
        f"element_at(transform(array(coalesce({code}, 1114112L)), n -> CASE WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN {_quoted(UNKNOWN)}"
        f" WHEN n BETWEEN 128 AND 159 THEN element_at({windows}, n)"
        " WHEN n < 9 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN ''"
        " ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END), 1)"
    )


def _inner_text(expr: str) -> str:
    """Text of a cell: tags as blanks, character references read once, blanks squeezed."""
    plain = f"regexp_replace({expr}, '<[^>]*>', ' ')"
    # Longer numbers than these are beyond the last code anyway.
    digits = "ltrim('0', substr(p, {0}, length(p) - {1}))"
    hexed = f"CASE WHEN length({digits.format(4, 4)}) <= 6 THEN cast(conv(substr(p, 4, length(p) - 4), 16, 10) AS bigint) END"
    plain_number = f"CASE WHEN length({digits.format(3, 3)}) <= 7 THEN cast(substr(p, 3, length(p) - 3) AS bigint) END"
    piece = (
        f"CASE WHEN rlike(p, '^&#[xX].') THEN {_numbered(hexed)} WHEN rlike(p, '^&#.') THEN {_numbered(plain_number)}"
        f" WHEN rlike(p, '^&.') THEN coalesce({_named('p')}, p) ELSE p END"
    )
    readable = f"array_join(transform(regexp_extract_all(t, '{ENTITY}', 0), p -> {piece}), '')"
    squeezed = "trim(regexp_replace({0}, '[\\\\s\\\\u00A0]+', ' '))"
    return (
        f"element_at(transform(array({plain}), t -> CASE WHEN contains(t, '&') THEN {squeezed.format(readable)}"
        f" ELSE {squeezed.format('t')} END), 1)"
    )


def _span(expr: str, name: str) -> str:
    found = f"regexp_extract({expr}, '(?i)\\\\b{name}\\\\s*=\\\\s*[\"\\']?\\\\s*(\\\\d+)', 1)"
    return f"greatest(1, coalesce(try_cast({found} AS int), 1))"


def table_cells(documents: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of every table of each document (table_no from 0), hidden cells for covered slots included.

    A document without a table element is read as one table. A table inside a cell is not told apart from its outer one.
    """
    bodies = f"regexp_extract_all({html}, '(?is)<table\\\\b[^>]*>(.*?)</table>', 1)"
    cells = "regexp_extract_all(r, '(?is)<t[hd]\\\\b[^>]*>.*?</t[hd]>', 0)"
    head = "regexp_extract(c, '(?is)^<t[hd]\\\\b[^>]*>', 0)"
    one = (
        f"element_at(transform(array({head}), h -> named_struct('text', {_inner_text('c')},"
        f" 'rs', CASE WHEN contains(lower(h), 'span') THEN {_span('h', 'rowspan')} ELSE 1 END,"
        f" 'cs', CASE WHEN contains(lower(h), 'span') THEN {_span('h', 'colspan')} ELSE 1 END)), 1)"
    )
    parsed = (
        f"transform(regexp_extract_all(body,"
        f" '(?is)<tr\\\\b[^>]*>(.*?)</tr>', 1), r -> transform({cells}, c -> {one}))"
    )
    # The generator keeps later expressions from repeating the parse.
    single = documents.selectExpr(key, f"posexplode(element_at(transform(array({bodies}), b -> CASE WHEN size(b) > 0 THEN b ELSE array({html}) END), 1)) AS (table_no, body)")
    flat = single.selectExpr(key, "table_no", f"explode(array({parsed})) AS html_rows")
    plain = (
        f"cast(flatten(transform(html_rows, (r, i) -> transform(r, (c, j) -> named_struct('row_no', i, 'col_no', j, 'text', c.text,"
        f" 'row_span', 1, 'col_span', 1, 'hidden', false)))) AS {CELL})"
    )
    items = "flatten(transform(html_rows, (r, i) -> transform(r, (c, j) -> named_struct('r', i, 'first', j = 0, 'c', c))))"
    # covered: slots taken by earlier cells; the next free column of the row is the first not covered.
    free = (
        "array_min(array_except(sequence(CASE WHEN x.first THEN 0 ELSE a.next END, CASE WHEN x.first THEN 0 ELSE a.next END + size(a.covered)),"
        " transform(filter(a.covered, s -> s.r = x.r), s -> s.c)))"
    )
    slots = (
        "flatten(transform(sequence(0, x.c.rs - 1), dr -> transform(sequence(0, x.c.cs - 1), dc -> named_struct('r', x.r + dr, 'c', col + dc))))"
    )
    fold = f"""aggregate({items}, named_struct('next', 0, 'covered', cast(array() AS array<struct<r:int,c:int>>), 'out', cast(array() AS {CELL})), (a, x) ->
        element_at(transform(array({free}), col -> named_struct(
          'next', col + x.c.cs,
          'covered', concat(filter(a.covered, s -> s.r >= x.r), {slots}),
          'out', concat(a.out, cast(array(named_struct('row_no', x.r, 'col_no', col, 'text', x.c.text, 'row_span', x.c.rs, 'col_span', x.c.cs, 'hidden', false)) AS {CELL}),
             cast(transform(slice({slots}, 2, x.c.rs * x.c.cs), s -> named_struct('row_no', s.r, 'col_no', s.c, 'text', '', 'row_span', 1, 'col_span', 1, 'hidden', true)) AS {CELL})))), 1),
        a -> a.out)"""
    spanned = "exists(html_rows, r -> exists(r, c -> c.rs > 1 OR c.cs > 1))"
    return flat.selectExpr(key, "table_no", f"inline(CASE WHEN {spanned} THEN {fold} ELSE {plain} END)")

"""DuckDB forms of the text functions, for the SQL that queries are held against."""

from __future__ import annotations

from fathom.functions.text import SUFFIXES


def _stem(words: str) -> str:
    one = "CASE WHEN length(w) < 3 THEN w WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END"
    cut = lambda n: f"left(w, length(w) - {n})"
    two = f"CASE WHEN w LIKE '%eed' THEN CASE WHEN length(w) > 4 THEN {cut(1)} ELSE w END WHEN w LIKE '%ed' THEN CASE WHEN regexp_matches({cut(2)}, '[aeiou]') THEN {cut(2)} ELSE w END WHEN w LIKE '%ing' THEN CASE WHEN regexp_matches({cut(3)}, '[aeiou]') THEN {cut(3)} ELSE w END ELSE w END"
    three = "CASE " + " ".join(f"WHEN w LIKE '%{s}' AND length(w) - {len(s)} >= 2 THEN left(w, length(w) - {len(s)}) || '{to}'" for s, to in SUFFIXES) + " ELSE w END"
    for body in (one, two, three):
        words = f"list_transform({words}, lambda w: {body})"
    return words


def doc_tokens(text: str) -> str:
    for pattern, to in ((r"```[\s\S]*?```", " "), ("`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"[#*_~>|]", " "), (r"\n", " "), (r"[^a-zA-Z0-9\s]", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    words = f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: length(t) > 2)"
    return f"list_distinct(list_concat({_stem(words)}, {words}))"


def code_tokens(text: str) -> str:
    split = text
    for pattern, to in ((r"([a-z])([A-Z])", r"\1 \2"), (r"([A-Z]+)([A-Z][a-z])", r"\1 \2"), (r"[_\-./\\:@]+", " "), (r"([a-zA-Z])(\d)", r"\1 \2"), (r"(\d)([a-zA-Z])", r"\1 \2"), (r"[^a-zA-Z0-9\s]", " ")):
        split = f"regexp_replace({split}, '{pattern}', '{to}', 'g')"
    words = f"list_filter(regexp_split_to_array(lower({split}), '\\s+'), lambda t: length(t) > 0)"
    names = f"list_transform(list_filter(regexp_split_to_array({text}, '[^a-zA-Z0-9_]+'), lambda t: length(t) > 1), lambda t: lower(t))"
    return f"list_distinct(list_concat({words}, {names}))"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def flag(test: str) -> str:
    return f"CAST({test} AS INT)"


def words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> ''))"


PASCAL, CAMEL, SNAKE, DOTTED = r"\b[A-Z][a-z]+[A-Z]\w*\b", r"\b[a-z]+[A-Z]\w*\b", r"\b\w+_\w+\b", r"\b\w+\.\w+\b"


def query_type(text: str) -> str:
    signals = " + ".join(flag(x) for x in (f"contains({text}, '(')", f"({has(text, PASCAL)} OR {has(text, r'\b[A-Z]{2,}[a-z]\w*\b')})", has(text, CAMEL), has(text, SNAKE), has(text, DOTTED), has(text, r"[{}();=]|=>|::")))
    asks = has(text, r"(?i)^(how|what|why|where|when|which|can|does|is|are|should)\b")
    return f"CASE WHEN {signals} >= 2 OR ({signals} >= 1 AND {words(text)} <= 3) THEN 'identifier' WHEN {asks} AND {words(text)} >= 3 THEN 'natural_language' ELSE 'mixed' END"


def decompose(text: str) -> str:
    joined = has(text, r"(?i)\b(and|but|or|versus|vs\.?|compared to|as well as|along with|plus)\b")
    several = has(text, r"(?i)\b(how|what|why|where|when|which)\b.*\b(and|also|additionally|moreover)\b")
    quoted = f"len(regexp_extract_all({text}, '\"[^\"\\n]*\\s[^\"\\n]*\"|''[^''\\n]*\\s[^''\\n]*''')) >= 2"
    names = f"len(regexp_extract_all({text}, '{PASCAL}|{CAMEL}|{SNAKE}|{DOTTED}')) >= 2"
    return "(" + " + ".join(flag(x) for x in (f"{words(text)} > 15", joined, several, quoted, names)) + ") >= 2"

"""Tokenizers, query classification, redaction and quality heuristics as Column expressions (no Python on the executors).

Word boundaries are ASCII: Java counts letters such as ü as word characters in \\b, so patterns use look-arounds instead. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order in which the first match wins.
SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("ization", "ize"), ("ation", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("ement", "e"), ("ment", ""), ("ness", ""), ("able", ""), ("ible", ""), ("ful", ""), ("less", ""), ("ive", ""), ("ize", ""), ("ise", ""),
    ("ly", ""), ("er", ""), ("or", ""),
]
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def word(pattern: str) -> str:
    """The pattern between ASCII word boundaries."""
    return f"{LEFT}(?:{pattern}){RIGHT}"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-zA-Z0-9\s]", " ")


def _pieces(text: Column, least: int) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) >= least)


def code_tokens(text: Column) -> Column:
    """Sub-words of camel, snake, kebab, dotted and path names and digits, then the names themselves; distinct, so each counts once."""
    split = text
    for pattern, to in ((r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (r"[_\-./\\:@]+", " "), (r"([a-zA-Z])(\d)", "$1 $2"), (r"(\d)([a-zA-Z])", "$1 $2")):
        split = F.regexp_replace(split, pattern, to)
    names = F.transform(F.filter(F.split(text, "[^a-zA-Z0-9_]+"), lambda t: F.length(t) > 1), F.lower)
    return F.array_distinct(F.concat(_pieces(_plain(split), 1), names))


def boosted_code_tokens(text: Column, identifiers: Column, symbol: Column) -> Column:
    """Code tokens, those of every identifier and the identifier, and twice those of the symbol's name; repeats stay and raise the term frequency."""
    subs = F.flatten(F.transform(identifiers, lambda i: F.concat(code_tokens(i), F.when(F.length(i) > 1, F.array(F.lower(i))).otherwise(F.array().cast("array<string>")))))
    named = F.coalesce(code_tokens(symbol), F.array().cast("array<string>"))
    return F.concat(code_tokens(text), F.coalesce(subs, F.array().cast("array<string>")), named, named)


def _singular(w: Column) -> Column:
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return F.when(F.length(w) < 3, w).when(w.endswith("sses"), cut(2)).when(w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(w.endswith("ss"), w).when(w.endswith("s"), cut(1)).otherwise(w)


def _tense(w: Column) -> Column:
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return F.when(~w.rlike("(?:ed|ing)$"), w).otherwise(
        F.when(w.endswith("eed"), F.when(F.length(w) > 4, cut(1)).otherwise(w))
        .when(w.endswith("ed"), F.when(cut(2).rlike("[aeiou]"), cut(2)).otherwise(w))
        .when(w.endswith("ing"), F.when(cut(3).rlike("[aeiou]"), cut(3)).otherwise(w))
        .otherwise(w)
    )


def _suffix(w: Column) -> Column:
    """The longest suffix that leaves two letters is replaced. Most words match none of the replaced ones, so two patterns decide for them."""
    changed = [(x, to) for x, to in SUFFIXES if to]
    dropped = "|".join(x for x, to in SUFFIXES if not to)
    out = w
    for suffix, to in reversed(changed):
        n = len(suffix)
        out = F.when(w.endswith(suffix) & (F.length(w) - n >= 2), F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(to))).otherwise(out)
    return F.when(w.rlike(f"^..+(?:{'|'.join(x for x, _ in changed)})$"), out).otherwise(F.regexp_replace(w, f"^(..+?)(?:{dropped})$", "$1"))


def stems(tokens: Column) -> Column:
    """Each step is a pass of its own, so expressions stay small. Words of one or two letters are kept by the caller's filter."""
    return F.transform(F.transform(F.transform(tokens, _singular), _tense), _suffix)


def doc_tokens(text: Column) -> Column:
    """Words of three letters or more outside code and markup, and their stems; distinct."""
    for pattern, to in ((r"```[\s\S]*?```", " "), ("`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1")):
        text = F.regexp_replace(text, pattern, to)
    words = F.array_distinct(F.transform(F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda t: F.length(t) > 2), F.lower))
    # Word and stem go through the steps as a pair, since a second use of `words` would compute it again.
    pairs = F.transform(words, lambda w: F.struct(w.alias("w"), _singular(w).alias("s")))
    pairs = F.transform(pairs, lambda p: F.struct(p["w"].alias("w"), _tense(p["s"]).alias("s")))
    return F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(_suffix(p["s"]), p["w"]))))


def token_count(text: Column) -> Column:
    """Tokens by length: three and a half characters each."""
    return F.ceil(F.length(text) / 3.5).cast("long")


def compact_number(n: Column) -> Column:
    """1234567 -> 1.2M, 1234 -> 1.2K."""
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def is_identifier(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$") & (F.length(t) > 2)


def is_flatcase(text: Column) -> Column:
    return text.rlike("^[a-z]{4,}$")


# Redactions in the order in which they run.
REDACTIONS = [
    (r"[a-zA-Z0-9_%+\-.]{1,64}@[a-zA-Z0-9-]{1,63}(?:\.[a-zA-Z0-9-]{1,63})*\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"https?://[^\s\"'<>()\[\]{}]+", "[URL]"),
    (r"[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}", "[JWT]"),
    (f"(?i){LEFT}(?:sk|pk|key|api|token|secret)-[A-Za-z0-9_-]{{8,}}", "[API_KEY]"),
    (word("[0-9a-fA-F]{32,}"), "[HEX]"),
    (word("[0-9]{6,}"), "[REDACTED_NUMBER]"),
    (r"(?<![A-Za-z0-9+/])[0-9a-fA-F]{32,}(?![A-Za-z0-9+/=])", "[HEX]"),
    (r"[A-Za-z0-9+/]{32,}={0,2}", "[BASE64]"),
]


def redact(text: Column) -> Column:
    """Mail addresses, URLs, tokens, keys, hex, long numbers and base64 replaced by their names."""
    for pattern, name in REDACTIONS:
        text = F.regexp_replace(text, pattern, name.replace("[", "\\[").replace("]", "\\]"))
    return F.coalesce(text, F.lit(""))


def _count(*tests: Column) -> Column:
    return sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))


def word_total(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


_PASCAL, _CAMEL, _SNAKE, _DOTTED = word(r"[A-Z][a-z]+[A-Z]\w*"), word(r"[a-z]+[A-Z]\w*"), word(r"\w+_\w+"), word(r"\w+\.\w+")


def query_type(text: Column) -> Column:
    """identifier, natural_language or mixed."""
    signals = _count(text.contains("("), text.rlike(_PASCAL) | text.rlike(word(r"[A-Z]{2,}[a-z]\w*")), text.rlike(_CAMEL), text.rlike(_SNAKE), text.rlike(_DOTTED), text.rlike(r"[{}();=]|=>|::"))
    n = word_total(text)
    asks = text.rlike(rf"(?i)^(how|what|why|where|when|which|can|does|is|are|should){RIGHT}")
    return F.when((signals >= 2) | ((signals >= 1) & (n <= 3)), "identifier").when(asks & (n >= 3), "natural_language").otherwise("mixed")


def query_alpha(kind: Column) -> Column:
    """Weight of the vector list for a query type."""
    return F.when(kind == "identifier", 0.3).when(kind == "natural_language", 0.7).otherwise(0.5)


def should_decompose(text: Column) -> Column:
    """At least two signs of a query with several parts."""
    quoted = F.regexp_count(text, F.lit(r"""\"[^\"\n]*\s[^\"\n]*\"|'[^'\n]*\s[^'\n]*'"""))
    names = F.regexp_count(text, F.lit("|".join((_PASCAL, _CAMEL, _SNAKE, _DOTTED))))
    joined = text.rlike(rf"(?i){LEFT}(?:and|but|or|versus|vs\.?|compared to|as well as|along with|plus){RIGHT}")
    several = text.rlike(rf"(?i){LEFT}(?:how|what|why|where|when|which){RIGHT}.*{LEFT}(?:and|also|additionally|moreover){RIGHT}")
    return _count(word_total(text) > 15, joined, several, quoted >= 2, names >= 2) >= 2


# Vocabulary of the quality heuristic.
TECHNICAL = "function|class|method|variable|parameter|return|error|bug|fix|feature|api|endpoint|database|table|column|component|module|service|handler|controller|config|deploy|server|client|request|response|query|mutation|schema|model|view|route|middleware|hook|callback|promise|async|await"
ACTIONS = "implement|create|add|remove|fix|update|refactor|migrate|configure|deploy|test|resolve|optimize|integrate|delete|modify|change|setup|install|build|run|execute|debug|trace|log|handle|process|validate|parse|serialize|fetch|send|receive|connect|disconnect"
VAGUE = "maybe|perhaps|somehow|something|stuff|things|whatever|somewhere|anyone|anything|some|kinda|sorta"
PRAISE = "good|bad|nice|cool|great|interesting|awesome|works|fine|ok|okay|perfect|excellent"
NOT_PRAISE = "good practice|bad pattern|nice feature|works well because|works by|good for"
EXTENSIONS = "ts|js|tsx|jsx|py|go|rs|java|cpp|c|h|md|json|yaml|yml|sql|sh|bash|css|scss|html"


def specificity(text: Column) -> Column:
    """0 to 1: concrete details raise it, vague or empty statements lower it."""
    has = lambda p: F.coalesce(text.rlike(p), F.lit(False))
    words, chars = word_total(text), F.length(text)
    digits, code, path = has(r"\d"), has(r"`[^`]+`|```[\s\S]*?```"), has(rf"\.({EXTENSIONS}){RIGHT}")
    prefers = has(rf"(?i){LEFT}(user|i|he|she|they|we)\s+(use[sd]?|like[sd]?|prefer[sd]?|has|have|had|want[sd]?|chose|always|never|switch)")
    add = lambda test, points: F.when(test, points).otherwise(0.0)
    score = F.lit(0.5) + add(digits, 0.1) + add(code, 0.2) + add(path, 0.15) + add(has(r":\d"), 0.1) + add(has("(?i)" + word(TECHNICAL)), 0.1)
    score += add(has("[A-Z][a-z]+(?:[A-Z][a-z]+)+") | has("[a-z]+_[a-z]+"), 0.05) + add(has("(?i)" + word(ACTIONS)), 0.1) + add(prefers, 0.2)
    very_short, short = (chars < 15) | (words < 3), (chars < 30) | (words < 5)
    score += add(has("(?i)" + word(VAGUE)), -0.2) + F.when(very_short, F.when(prefers, -0.15).otherwise(-0.35)).when(short, F.when(prefers, -0.05).otherwise(-0.2)).otherwise(0.0)
    score += add(has("(?i)" + word(PRAISE)) & ~has("(?i)" + word(NOT_PRAISE)), -0.15)
    score += add(F.trim(text).rlike(r"(?i)^(the )?(code|it|this|that)?\s*(is|are|was|were)?\s*(good|nice|great|fine|ok|cool|awesome|works|working)"), -0.25)
    score += add((words < 8) & ~code & ~path & ~digits & ~prefers, -0.15)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


# What makes a text clear or unclear, and by how much.
CLARITY = {"good_sentences": 0.15, "list": 0.1, "paragraphs": 0.05, "ends_well": 0.1, "shouting": -0.1, "no_spaces": -0.3, "repeated_characters": -0.2}
SENTENCE_LENGTH = (30, 150)


def clarity(text: Column) -> Column:
    """0 to 1: sentences of middling length, lists and paragraphs raise it, shouting, missing spaces and runs of one character lower it."""
    gap = r"[ \t\n\r\f\x0B]"
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda x: x.rlike(r"[^ \t\n\r\f\x0B]")))
    mean = F.length(text) / F.greatest(sentences, F.lit(1))
    signs = {
        "good_sentences": mean.between(*SENTENCE_LENGTH),
        "list": text.rlike(r"\A[-*•]|\n[-*•]|\n[0-9]+\."),
        "paragraphs": text.rlike(rf"\n\n|:{gap}*\n"),
        "ends_well": text.rlike(rf"[.!?]{gap}*\z"),
        "shouting": F.regexp_count(text, F.lit("[A-Z]{3,}")) > 2,
        "no_spaces": (F.length(text) > 50) & ~text.contains(" "),
        "repeated_characters": text.rlike(r"([^\n\r])\1{4,}"),
    }
    score = sum((F.when(test, CLARITY[sign]).otherwise(0.0) for sign, test in signs.items()), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


# Weights of a quality score without a model, and what stands for an unknown factor.
QUALITY = {"specificity": 0.3, "clarity": 0.3, "relevance": 0.2, "uniqueness": 0.2}
NEUTRAL = 0.5


def heuristic_quality(text: Column, similarity: Column | None = None) -> Column:
    """Quality without a model; similarity: to the nearest stored text, null if unknown."""
    unique = F.lit(NEUTRAL) if similarity is None else F.coalesce(1 - similarity, F.lit(NEUTRAL))
    factors = {"specificity": specificity(text), "clarity": clarity(text), "relevance": F.lit(NEUTRAL), "uniqueness": unique}
    return sum((QUALITY[k] * v for k, v in factors.items()), F.lit(0.0))


def escape_xml(text: Column) -> Column:
    """Control characters dropped, the five XML characters escaped."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for c, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(c), F.lit(to))
    return text


def truncate(text: Column, most: int = 5000, mark: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def normal_source(source: Column) -> Column:
    """Folder of a file path, other paths as they are, else lower case."""
    s = F.regexp_replace(F.trim(F.coalesce(source, F.lit(""))), r"\\", "/")
    return F.when(s.contains("/"), F.when(F.element_at(F.split(s, "/"), -1).contains("."), F.regexp_replace(s, "/[^/]*$", "")).otherwise(s)).otherwise(F.lower(s))


# Words that tell the scope of a question, in the order in which they are tried.
SCOPES = [
    ("directory", ["directory", "folder", "namespace", "dir "]),
    ("module", ["module", "subsystem", "component", "layer", "package"]),
    ("repo", ["project", "codebase", "repository", "overview", "architecture", "describe this", "what does this do"]),
]


def summary_level(text: Column) -> Column:
    """Scope of a question: file for names of files and symbols, else by its words, else directory."""
    out = F.lit("directory")
    for name, words in reversed(SCOPES):
        out = F.when(F.lower(text).rlike("|".join(words)), name).otherwise(out)
    return F.when(text.rlike(rf"(?i)\.({EXTENSIONS})(?:\s|$)") | text.rlike("[a-z][A-Z]") | text.rlike("[a-zA-Z]{2,}_[a-zA-Z]{2,}"), "file").otherwise(out)


def looks_like_code(text: Column) -> Column:
    return text.rlike(r"[{}();=]|=>|\.\w+\(")


def bridge_relation(text: Column, tags: Column) -> Column:
    """Relation of a memory to the code it names: bug_in before test_covers before motivates before documents."""
    # Keywords and tags of the relations.
    kinds = [
        ("bug_in", r"bug|error|fix|crash|exception|traceback|stack\s*trace|regression|broken|failed|failure", ["error", "bug", "fix", "debug", "dead_end"]),
        ("test_covers", "tests?|specs?|coverage|assertions?|mocks?|stubs?|fixtures?|jest|vitest|pytest|mocha", ["test", "testing", "spec"]),
        ("motivates", "pattern|architecture|design|approach|strategy|convention|principle", ["pattern", "architecture", "decision"]),
    ]
    out = F.lit("documents")
    for name, words, marks in reversed(kinds):
        out = F.when(text.rlike("(?i)" + word(words)) | F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, marks))), F.lit(False)), name).otherwise(out)
    return out


def glob_to_regex(glob: str) -> str:
    """A path glob with *, ** and ?: one without a slash matches the last part of a path."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return ("^" if "/" in glob else "(?:^|/)") + out + "$"


def safe_regex(pattern: str, most: int = 500) -> str | None:
    """The pattern for a case-insensitive filter, or None if it is too long, has nested quantifiers, or isn't a pattern."""
    import re

    if not pattern or len(pattern) > most or re.search(r"\([^)]*[+*][^)]*\)[+*{]", pattern):
        return None
    try:
        re.compile(pattern)
    except re.error:
        return None
    return f"(?i){pattern}"

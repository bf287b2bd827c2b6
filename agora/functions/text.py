"""Text predicates and extractors as Spark Column expressions.

All of these are per-row expressions built from Spark SQL built-ins (regex,
higher-order array functions, hashing), so they run inside the JVM next to
the scan: no Python UDF, no shuffle. The regex strings are also valid RE2, so
the same patterns can be handed to another engine as an oracle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora import lexicon

# A "word character" as Python's Unicode-aware \w sees it: letters, numbers,
# underscore. Spelled out because \w and \b are ASCII-only in some engines.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
# Entity tokens: a letter followed by word chars and . + # -
ENTITY_TOKEN = r"[A-Za-z][\w.+#-]*"
# Keyword-extractor tokens: 2+ lower-case ASCII letters (after lower()).
TF_TOKEN = r"[a-z]{2,}"
# TF-IDF tokens: 2+ word characters (Unicode).
TFIDF_TOKEN = WORD + "{2,}"
# Leading/trailing whitespace, Unicode spaces included.
_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _is_word_char(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _quote(term: str) -> str:
    """Regex-quote a literal term (\\Q..\\E works in Java and RE2)."""
    if "\\E" in term:
        return "".join("\\" + c if not c.isalnum() else c for c in term)
    return "\\Q" + term + "\\E"


def boundary_pattern(term: str) -> str:
    """Regex equal to ``\\b<term>\\b`` with Unicode word characters.

    A boundary next to a word character needs a non-word char or the string
    edge on the other side; next to a non-word character (a term ending in
    '+' or '.') it needs a word character, exactly as ``\\b`` does.
    """
    left = f"(?:^|{NON_WORD})" if _is_word_char(term[0]) else WORD
    right = f"(?:{NON_WORD}|$)" if _is_word_char(term[-1]) else WORD
    return left + _quote(term) + right


def any_term_pattern(terms: Iterable[str]) -> str | None:
    """One alternation regex matching any single-word term on boundaries.

    Terms are grouped by the boundary rule they need so each group becomes a
    single alternation; the result is a plan-time literal.
    """
    groups: dict[tuple[bool, bool], list[str]] = {}
    for t in dict.fromkeys(terms):
        if not t:
            continue
        key = (_is_word_char(t[0]), _is_word_char(t[-1]))
        groups.setdefault(key, []).append(t)
    parts = []
    for (w_left, w_right), ts in groups.items():
        left = f"(?:^|{NON_WORD})" if w_left else WORD
        right = f"(?:{NON_WORD}|$)" if w_right else WORD
        parts.append(left + "(?:" + "|".join(_quote(t) for t in ts) + ")" + right)
    return "|".join(parts) if parts else None


def any_phrase_pattern(phrases: Iterable[str]) -> str | None:
    """Alternation regex for plain substring containment of any phrase."""
    ps = [p for p in dict.fromkeys(phrases) if p]
    return "|".join(_quote(p) for p in ps) if ps else None


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def is_blank(col: Column) -> Column:
    """True for NULL or whitespace-only text (P6, ingestion rule)."""
    return col.isNull() | col.rlike(r"^[\s\p{Z}]*$")


def scope_match(title: Column, extra_terms: Sequence[str] | None = None,
                keywords: Sequence[str] = lexicon.DEFAULT_TOPIC_KEYWORDS) -> Column:
    """Is a story title in the debate scope?

    'ask hn:' / 'show hn:' prefixes are always in scope; otherwise any
    keyword matches - phrases (with a space) as substrings, single words on
    word boundaries, case-insensitively. Built as two literal alternation
    regexes, folded once at plan time.
    """
    lowered = [k.lower() for k in list(keywords) + list(extra_terms or [])]
    t = F.lower(py_strip(F.coalesce(title, F.lit(""))))
    cond = F.lit(False)
    for prefix in lexicon.ALWAYS_IN_SCOPE_PREFIXES:
        cond = cond | t.startswith(prefix)
    words = any_term_pattern(k for k in lowered if " " not in k)
    phrases = any_phrase_pattern(k for k in lowered if " " in k)
    if words:
        cond = cond | t.rlike(words)
    if phrases:
        cond = cond | t.rlike(phrases)
    return cond


def target_entities(title: Column, max_entities: int | None = None,
                    known: Sequence[str] = lexicon.KNOWN_ENTITIES,
                    stop: Sequence[str] = lexicon.ENTITY_STOP_WORDS) -> Column:
    """Entities of a title, as an array in title order.

    A token is kept if it is a known entity (any case), or if it is not the
    first token, starts upper-case, is longer than 2 and is not a stop word.
    Case-insensitive duplicates keep the first spelling. All are returned,
    or the first ``max_entities`` if given.
    """
    known_arr = F.array(*[F.lit(k.lower()) for k in known])
    stop_arr = F.array(*[F.lit(s) for s in stop])
    toks = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(ENTITY_TOKEN), 0)

    def eligible(tok: Column, i: Column) -> Column:
        low = F.lower(tok)
        capital = (i > 0) & tok.rlike("^[A-Z]") & (F.length(tok) > 2) & \
            ~F.array_contains(stop_arr, low)
        return F.when(F.array_contains(known_arr, low) | capital, tok)

    kept = F.filter(F.transform(toks, eligible), lambda x: x.isNotNull())
    first = F.filter(kept, lambda t, i: ~F.exists(
        F.slice(kept, F.lit(1), i), lambda u: F.lower(u) == F.lower(t)))
    return first if max_entities is None else F.slice(first, 1, max_entities)


def split_terms(raw: Column) -> Column:
    """Comma-separated terms -> trimmed, non-blank array; NULL -> []."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ","), py_strip)
    return F.filter(parts, lambda t: t != "")


def text_units(text: Column) -> Column:
    """A text cut into its word runs and its single other characters."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}+|{NON_WORD}"), 0)


def _is_word(unit: Column) -> Column:
    return unit.rlike("^" + WORD)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row however often ``body`` names it.

    An expression inside a lambda is computed anew for every element; a
    lambda's own variable is not.
    """
    return F.exists(F.array(value), body)


def _units_hit(units: Column, term: Column) -> Column:
    """Do the units of a term follow each other somewhere among ``units``?

    Word runs are whole on both sides, so a term that starts or ends with one
    has its boundaries there. Next to another character at the term's edge a
    word must stand, as ``\\b`` asks.
    """
    def at(t: Column, i: Column) -> Column:
        left = _is_word(t[0]) | F.coalesce(_is_word(F.get(units, i - 1)), F.lit(False))
        right = _is_word(F.element_at(t, -1)) | F.coalesce(_is_word(F.get(units, i + F.size(t))), F.lit(False))
        return (F.slice(units, i + 1, F.size(t)) == t) & left & right

    return _let(text_units(term), lambda t: F.exists(
        F.sequence(F.lit(0), F.greatest(F.size(units) - F.size(t), F.lit(0))), lambda i: at(t, i)))


def on_target(body: Column, terms: Column) -> Column:
    """P5: does the body mention any target term?

    No usable terms -> True (cannot gate). Multi-word terms match as
    substrings, single words on word boundaries, case-insensitively.

    A body is lowered once and first searched for the terms as plain
    substrings. Only bodies that hold one are cut into words: terms of word
    characters are then looked up among the words (a hash set per row), others
    ('c++', 'node.js') compared unit by unit. No regex is built from a column,
    and no row leaves its partition: the terms come with the comment's post,
    so an index of terms joined to exploded tokens would shuffle every token
    for the same answer.
    """
    cleaned = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")),
                                   py_strip), lambda t: t != "")
    lowered = F.transform(cleaned, F.lower)

    def hit(text: Column, found: Column) -> Column:
        phrase = F.exists(found, lambda t: t.contains(" "))
        words = F.filter(found, lambda t: ~t.rlike(NON_WORD))
        mixed = F.filter(found, lambda t: t.rlike(NON_WORD) & ~t.contains(" "))
        return (phrase
                | ((F.size(words) > 0) & F.arrays_overlap(F.regexp_extract_all(text, F.lit(WORD + "+"), 0), words))
                | ((F.size(mixed) > 0) & _let(text_units(text), lambda u: F.exists(
                    mixed, lambda t: _units_hit(u, t)))))

    mentioned = _let(F.lower(F.coalesce(body, F.lit(""))), lambda text: _let(
        F.filter(lowered, lambda t: text.contains(t)),
        lambda found: (F.size(found) > 0) & hit(text, found)))
    return (F.size(cleaned) == 0) | mentioned


def author_hash(author: Column) -> Column:
    """SHA-256 hex of the author name; NULL for missing or empty."""
    return F.sha2(F.nullif(author, F.lit("")), 256)


def author_tag(author_hash_col: Column) -> Column:
    """Short author tag, first 8 hex chars (NULL-safe)."""
    return F.substring(author_hash_col, 1, 8)


def tf_tokens(text: Column) -> Column:
    """Tokens of the term-frequency fallback: ``[a-z]{2,}`` of lower(text)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TF_TOKEN), 0)


def tfidf_tokens(text: Column) -> Column:
    """Tokens of the TF-IDF path: 2+ Unicode word characters of lower(text)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TFIDF_TOKEN), 0)


def word_tokens(text: Column) -> Column:
    """Lower-cased words (1+ word characters) for lexicon scorers."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD + "+"), 0)


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(py_strip(F.coalesce(text, F.lit(""))), r"[\s\p{Z}]+"),
                           lambda w: w != ""))


def permalink(external_id: Column, base: str = lexicon.PERMALINK_BASE) -> Column:
    """Forum permalink of an item."""
    return F.concat(F.lit(base), external_id)

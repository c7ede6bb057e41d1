"""Text functions as Column expressions: names, keys, tokens, query terms."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import INTENTS, STOPWORDS

_BOUNDARY = r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=[0-9])"
WORD = r"[^\p{L}\p{N}_]+"
PROSE = r"[^\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def base_name(name: Column | str) -> Column:
    """What stands before the generics."""
    return F.trim(F.substring_index(col(name), "<", 1))


def norm_key(value: Column | str) -> Column:
    """Lookup key: without generics (nested to any depth; an open one hides the rest), blanks, one final () and one
    leading ::, in lower case."""
    c = col(value)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))

    def step(a: Column, ch: Column) -> Column:
        opens, closes = ch == "<", ch == ">"
        out = F.when(opens & (a["depth"] == 0), F.regexp_replace(a["out"], r"::\s*$", "")).when(opens | closes | (a["depth"] > 0), a["out"]).otherwise(F.concat(a["out"], ch))
        depth = F.when(opens, a["depth"] + 1).when(closes, F.greatest(a["depth"] - 1, F.lit(0))).otherwise(a["depth"])
        return F.struct(out.alias("out"), depth.alias("depth"))

    c = F.when(c.contains("<"), F.aggregate(F.split(c, ""), start, step)["out"]).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\(\)$", "")
    return F.lower(F.regexp_replace(c, "^::", ""))


def singular(term: Column | str) -> Column:
    t = col(term)
    n = F.octet_length(t)
    return (
        F.when((n > 4) & t.endswith("ies"), F.concat(F.regexp_replace(t, "ies$", ""), F.lit("y")))
        .when(t.rlike("(ches|shes|xes|zes)$"), F.regexp_replace(t, "es$", ""))
        .when((n > 3) & t.rlike("[^su]s$"), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def name_tokens(name: Column | str) -> Column:
    """Words of an identifier, singular, in order."""
    spaced = F.lower(F.regexp_replace(col(name), _BOUNDARY, " "))
    return F.transform(F.array_remove(F.split(spaced, "[^a-z0-9]+", -1), ""), singular)


def identifier_tokens(text: Column | str) -> Column:
    """The identifier tokenizer: each word in lower case, then those of its parts that differ from it."""
    raw = F.array_remove(F.split(col(text), WORD, -1), "")
    return F.flatten(F.transform(raw, lambda w: F.concat(F.array(F.lower(w)), F.filter(name_tokens(w), lambda p: p != F.lower(w)))))


def prose_tokens(text: Column | str, longest: int = 40) -> Column:
    """The prose tokenizer; words of ``longest`` bytes and more are left out."""
    return F.filter(F.split(F.lower(col(text)), PROSE, -1), lambda w: (w != "") & (F.octet_length(w) < longest))


def query_words(query: Column | str) -> Column:
    words = F.split(F.lower(col(query)), WORD, -1)
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOPWORDS)))


def query_terms(query: Column | str) -> Column:
    """Words, their singulars and their parts, each once in order of appearance."""
    words = F.filter(F.split(F.lower(col(query)), WORD, -1), lambda w: (F.octet_length(w) >= 2) & ~w.isin(*STOPWORDS))
    every = F.flatten(F.transform(words, lambda w: F.concat(F.array(w, singular(w)), name_tokens(w))))
    return F.array_distinct(F.filter(every, lambda t: F.octet_length(t) > 1))


def subjects(query: Column | str) -> Column:
    """Terms without intent verbs, singular, each once."""
    return F.array_distinct(F.transform(F.filter(query_terms(query), lambda t: ~t.isin(*INTENTS)), singular))


def common_prefix(a: Column | str, b: Column | str) -> Column:
    x, y = col(a), col(b)
    n = F.least(F.length(x), F.length(y))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(x, F.lit(1), i) == F.substr(y, F.lit(1), i)))).otherwise(0)


def normalized_signature(signature: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(signature), r"\s+", ""), r",(?=[)>\]}])", "")


def block_text(text: Column | str) -> Column:
    """No carriage returns, at most one empty line in a row, single blanks, trimmed."""
    c = F.regexp_replace(F.regexp_replace(col(text), "\r", ""), "\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(c, "[ \t]+", " "))


def clip(text: Column | str, chars: int = 2000) -> Column:
    c = col(text)
    return F.when(F.length(c) > chars, F.concat(F.rtrim(F.left(c, F.lit(chars))), F.lit(" …"))).otherwise(c)


def truncate_bytes(text: Column | str, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, cut between characters: a character cut in two decodes to the
    replacement character, which goes."""
    c = col(text)
    cut = F.substring(F.encode(c, "UTF-8"), 1, limit)
    whole = F.decode(cut, "UTF-8")
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.regexp_replace(whole, "�+$", ""))


# The same for query strings that the caller holds, so that plans get literals.


def py_singular(t: str) -> str:
    if len(t.encode()) > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if t.endswith(("ches", "shes", "xes", "zes")):
        return t[:-2]
    return t[:-1] if len(t.encode()) > 3 and t.endswith("s") and not t.endswith(("ss", "us")) else t


def py_name_tokens(name: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[^\W\d_])(?=[0-9])", " ", name).lower()
    return [py_singular(x) for x in re.split("[^a-z0-9]+", spaced) if x]


def _kept(query: str) -> list[str]:
    return [w for w in re.split(r"\W+", query.lower()) if len(w.encode()) >= 2 and w not in STOPWORDS]


def py_query_terms(query: str) -> list[str]:
    every = [t for w in _kept(query) for t in (w, py_singular(w), *py_name_tokens(w))]
    return list(dict.fromkeys(t for t in every if len(t.encode()) > 1))


def py_query_words(query: str) -> list[str]:
    return list(dict.fromkeys(_kept(query)))


def py_subjects(query: str) -> list[str]:
    return list(dict.fromkeys(py_singular(t) for t in py_query_terms(query) if t not in INTENTS))


def py_norm_key(value: str) -> str:
    if "<" in value:
        out, depth = "", 0
        for ch in value:
            if ch == "<":
                out = re.sub(r"::\s*$", "", out) if depth == 0 else out
                depth += 1
            elif ch == ">":
                depth = max(0, depth - 1)
            elif depth == 0:
                out += ch
        value = out
    value = re.sub(r"\(\)$", "", re.sub(r"\s+", "", value))
    return re.sub("^::", "", value).lower()


def is_symbol(query: Column | str) -> Column:
    """Whether a query has the shape of a name: one word, or a path."""
    return col(query).rlike(r"(?U)^\s*\S+\s*\z") | col(query).contains("::")


def is_error_page(file: Column | str) -> Column:
    """File names of error codes: B, four digits, .md."""
    return col(file).rlike(r"^B[0-9]{4}\.md\z")

"""Tokenisers, normalisers and token-array tests, all of built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation, accents and their base letters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡"
EDGE_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’¡¿"
ANSWER_MARKS = ".,!?¿¡;:\"'“”„«»…—–-"
ACCENTED = "âêîôûŵŷäëïöüÿáéíóú"
BASE = "aeiouwyaeiouyaeiou"
_SPACES = "(?U)\\s+"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in chars) + "]+"


def words(text: Column) -> Column:
    """Lower-cased tokens without any punctuation; tokens of punctuation alone are dropped."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.trim(text)), _class(PUNCTUATION), ""), _SPACES), "")


def edge_words(text: Column) -> Column:
    """Tokens without punctuation at their ends; the case stays."""
    strip = _class(EDGE_PUNCTUATION)
    return F.filter(F.transform(F.split(F.trim(text), _SPACES), lambda w: F.regexp_replace(w, f"^{strip}|{strip}$", "")), lambda w: w != "")


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fold_accents(text: Column) -> Column:
    """Case-folded, with the vowels that Welsh spelling varies as plain ones; other accents stay."""
    return F.translate(casefold(text), ACCENTED, BASE)


_MARKED = [c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if len(unicodedata.normalize("NFD", c)) > 1]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]
#: Marks and what they make of a plain letter, in canonical order.
_COMPOSED = [(base + mark, c) for base in map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B))) for mark in "\u0300\u0301\u0302\u0303\u0308\u0327" if len(c := unicodedata.normalize("NFC", base + mark)) == 1]


def without_diacritics(text: Column) -> Column:
    """Letters without their marks, whether they are written as one character or as two."""
    return F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_PLAIN)), "[\u0300-\u036f^`\u00a8\u00af\u00b4\u00b7\u00b8]", "")


def composed(text: Column) -> Column:
    """Letters with one of six marks as one character (NFC of Latin letters); other texts are left as they are."""
    marked = (F.octet_length(text) > F.length(text)) & F.rlike(text, F.lit("[\u0300-\u036f]"))  # plain ASCII has none
    return F.when(marked, reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), _COMPOSED, text)).otherwise(text)


def intl_words(text: Column) -> Column:
    """Tokens of the international mteval rules: punctuation stands alone unless it's inside a number, symbols always; the case stays."""
    apart = F.regexp_replace(F.regexp_replace(text, "(\\P{N})(\\p{P})", "$1 $2 "), "(\\p{P})(\\P{N})", " $1 $2")
    return F.filter(F.split(F.trim(F.regexp_replace(apart, "(\\p{S})", " $1 ")), _SPACES), lambda w: w != "")


def key(text: Column) -> Column:
    """A key for comparisons: trimmed, case-folded, runs of white space as one space."""
    return F.regexp_replace(casefold(F.trim(text)), _SPACES, " ")


def ngrams(tokens: Column, n: int) -> Column:
    """Shifted copies zipped together: an index into ``tokens`` inside a lambda would evaluate its expression for every place."""
    size = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, F.lit(1), size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(tokens, F.lit(k), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def with_clitic_heads(tokens: Column) -> Column:
    """The tokens, and for those with an apostrophe what stands before the first; a straight one is tried before a curly one."""
    def head(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("'")), F.substring_index(t, "'", 1)).when(F.contains(t, F.lit("’")), F.substring_index(t, "’", 1))

    return F.filter(F.flatten(F.transform(tokens, lambda t: F.array(t, head(t)))), lambda t: t.isNotNull() & (t != ""))


def starts_of(tokens: Column, phrase: Column) -> Column:
    """The positions (from 1) where the phrase's tokens stand next to each other."""
    last = F.size(tokens) - F.size(phrase) + 1
    return F.when((last >= 1) & (F.size(phrase) > 0), F.filter(F.sequence(F.lit(1), last), lambda i: F.slice(tokens, i, F.size(phrase)) == phrase)).otherwise(F.array().cast("array<int>"))


def contains_run(tokens: Column, phrase: Column) -> Column:
    return F.size(starts_of(tokens, phrase)) > 0


def spans(text: Column) -> Column:
    """Parts (token, start, end, word): runs of letters, digits and _ and what stands between, with offsets from 0."""
    parts = F.filter(F.split(text, "(?<=[\\p{L}\\p{N}_])(?![\\p{L}\\p{N}_])|(?<![\\p{L}\\p{N}_])(?=[\\p{L}\\p{N}_])"), lambda p: p != "")
    zero = F.named_struct(F.lit("at"), F.lit(0), F.lit("out"), F.array().cast("array<struct<token:string,start:int,end:int,word:boolean>>"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.length(part)
        one = F.named_struct(F.lit("token"), part, F.lit("start"), state["at"], F.lit("end"), end, F.lit("word"), F.rlike(part, F.lit("^[\\p{L}\\p{N}_]")))
        return F.named_struct(F.lit("at"), end, F.lit("out"), F.concat(state["out"], F.array(one)))

    return F.aggregate(parts, zero, step)["out"]


def cloze(text: Column, word: Column) -> Column:
    """The text with the first whole-word occurrence of the word, whatever its case, as ____."""
    quoted = F.concat(F.lit("(?iU)(?<![\\p{L}\\p{N}_])\\Q"), word, F.lit("\\E(?![\\p{L}\\p{N}_])"))
    first = F.regexp_substr(text, quoted)
    at = F.regexp_instr(text, quoted)
    return F.when(first.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.lit("____"), F.substring(text, at + F.length(first), F.length(text))))


#: As many words as a recogniser takes at once.
MOST_KEYTERMS = 100


def keyterms(sentence: Column, most: int = MOST_KEYTERMS) -> Column:
    """The sentence's words without marks at their ends, each once whatever its case, as first written; ``most`` at most."""
    own = F.filter(F.transform(F.split(sentence, _SPACES), lambda w: F.btrim(w, F.lit(ANSWER_MARKS))), lambda w: w != "")
    low = F.transform(own, F.lower)
    return F.slice(F.filter(own, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, most)


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def prefix_fraction(tokens: Column, variants: Column) -> Column:
    """How much of a variant (an array of arrays) the end of the token sequence has matched: 1.0 once one was completed.

    Each variant is followed through the tokens: the next token goes on, the first one begins anew, any other one ends it.
    """

    def one(variant: Column) -> Column:
        def step(at: Column, token: Column) -> Column:
            on = (at < F.size(variant)) & (F.get(variant, at) == token)
            return F.when(at >= F.size(variant), at).when(on, at + 1).when(F.get(variant, F.lit(0)) == token, 1).otherwise(0)

        return F.when(F.size(variant) > 0, F.aggregate(tokens, F.lit(0), step) / F.size(variant)).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(variants, one)), F.lit(0.0))


def tracked(tokens: Column, gold: Column, banned: Column) -> Column:
    """satisfied (a gold variant was completed), violated (a banned one was; it stays so) and progress of a token stream."""
    return F.struct((prefix_fraction(tokens, gold) == 1).alias("satisfied"), (prefix_fraction(tokens, banned) == 1).alias("violated"), prefix_fraction(tokens, gold).alias("progress"))


def clitic_match(tokens: Column, expected: Column, proclitics: str) -> Column:
    """strict or clitic_stripped, of the first token that is the form as it is or without leading proclitics; null if none."""
    want = key(expected)
    bare = lambda t: F.regexp_replace(t, f"^[{proclitics}]+", "")
    kinds = F.transform(tokens, lambda t: F.when(key(t) == want, "strict").when((bare(t) != "") & (key(bare(t)) == want), "clitic_stripped"))
    return F.get(F.filter(kinds, lambda k: k.isNotNull()), F.lit(0))


def article_agrees(tokens: Column, noun: Column, articles: Column) -> Column:
    """Whether one of the articles stands one or two tokens before the noun; null without a noun or articles."""
    low, want, own = F.transform(tokens, casefold), casefold(noun), F.transform(articles, casefold)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1))), lambda i: F.get(low, i - 1) == want)
    before = lambda i: F.slice(low, F.greatest(i - 2, F.lit(1)), F.least(i - 1, F.lit(2)))
    return F.when((F.coalesce(want, F.lit("")) != "") & (F.size(own) > 0), F.exists(at, lambda i: (i > 1) & F.arrays_overlap(before(i), own)))


def json_text(raw: Column, path: str) -> Column:
    """The value at a JSON path as text; null where the path or the JSON isn't there."""
    return F.get_json_object(raw, path)


def json_int(raw: Column, path: str) -> Column:
    """The value at a JSON path as a whole number; null where it isn't one."""
    return F.get_json_object(raw, path).try_cast("int")

"""Column functions over text, ids and lengths."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number of bits of the fraction in hash_fraction, and the split's bounds.
SPLIT_BOUNDS = ((0.8, "train"), (0.9, "validation"))
# What a template puts marks in the place of, and what its words are.
_SLOTS = [(re.compile(r"https?://\S+"), " URL "), (re.compile('"[^"\n]*"|\u201c[^\u201d\n]*\u201d'), " SLOT "), (re.compile(r"\b\d+(?:[.:-]\d+)*\b"), " NUMBER ")]
_TOKENS = re.compile("[a-z_]+|[\u3400-\u9fff]|[^\\W\\d_]+")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def rank_key(domain: str, seed: int, ident: Column) -> Column:
    """Hash by which rows are ordered instead of at random: SHA-256 of the JSON list of domain, seed and id."""
    return F.sha2(F.concat(F.lit(f'["{domain}",{seed},"'), ident.cast("string"), F.lit('"]')), 256)


def hash_fraction(digest: Column) -> Column:
    """The first 64 bits of a hexadecimal digest, as a fraction of 2**64."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def hash_split(ident: Column, seed: int, ood_fraction: float) -> Column:
    ood = hash_fraction(rank_key("ood", seed, ident))
    u = hash_fraction(rank_key("split", seed, ident))
    usual = F.when(u < SPLIT_BOUNDS[0][0], SPLIT_BOUNDS[0][1]).when(u < SPLIT_BOUNDS[1][0], SPLIT_BOUNDS[1][1]).otherwise("test")
    return F.when(ood < ood_fraction, "ood_test").otherwise(usual)


def length_bucket(n: Column, bounds: list[int]) -> Column:
    out = F.lit("over_limit")
    for b in sorted(bounds, reverse=True):
        out = F.when(n <= b, f"le_{b}").otherwise(out)
    return out


def smallest_bucket(n: Column, bounds: list[int]) -> Column:
    out = F.lit(None).cast("bigint")
    for b in sorted(bounds, reverse=True):
        out = F.when(n <= b, F.lit(b).cast("bigint")).otherwise(out)
    return out


def script_label(text: Column) -> Column:
    han, latin = text.rlike("[㐀-鿿]"), text.rlike("[A-Za-z]")
    return F.when(han & latin, "han_and_latin").when(han, "han").when(latin, "latin").otherwise("other")


def template(text: Column) -> Column:
    """Words of a text with URLs, quoted parts and numbers replaced by marks; for ASCII texts."""
    t = F.regexp_replace(F.lower(text), r"https?://[^\s]+", "URL")
    t = F.regexp_replace(t, "\"[^\"\n]*\"", "SLOT")
    t = F.regexp_replace(t, r"[0-9]+(?:[.,][0-9]+)*", "NUMBER")
    return F.array_join(F.regexp_extract_all(t, F.lit("[a-z_]+|[A-Z]+"), F.lit(0)), " ")


def template_of(text: str | None) -> str | None:
    """The task template of a text of any script: folded, with URLs, quoted parts and numbers as marks, and its words in order."""
    if text is None:
        return None
    folded = unicodedata.normalize("NFKC", text).casefold()
    for pattern, mark in _SLOTS:
        folded = pattern.sub(mark, folded)
    return " ".join(_TOKENS.findall(folded))


def task_template(text: Column) -> Column:
    """template_of, on a hundred rows at a time: ten thousand whole texts would stand in an Arrow batch."""
    return F.udf(template_of, "string", useArrow=False)(text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_]+|[㐀-鿿]|\p{L}+"), F.lit(0))


def shingles(tokens: Column, size: int = 3, least: int = 8) -> Column:
    """Distinct runs of `size` tokens; none where there are fewer than `least` tokens."""
    run = lambda i: F.array_join(F.slice(tokens, i, size), " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (size - 1)), run)
    return F.when(F.size(tokens) >= least, F.array_distinct(runs))


def with_shingles(df, text: str = "text", out: str = "sh", least: int = 8):
    """The rows of df that have shingles, with them. The tokens are bound to a lambda's variable: as a column they would
    be inlined wherever the optimizer copies the expression below a filter, and then be found anew for each shingle."""
    bound = F.get(F.transform(F.array(words(F.col(text))), lambda w: shingles(w, least=least)), F.lit(0))
    return df.withColumn(out, bound).filter(F.size(out) > 0)


def known_rate(flag: Column) -> Column:
    """The share of true, or null if any is unknown or there is none."""
    return F.when((F.count(flag) == F.count("*")) & (F.count("*") > 0), F.count_if(flag) / F.count("*"))

"""Name normalization, entity decoding, canonical JSON and digests."""

from pyspark.sql import Column, functions as F

from .. import pytasks

# Named entities and the text they stand for.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def nfkc(c: Column) -> Column:
    """Unicode NFKC form. ASCII text is its own form and goes to Arrow as NULL."""
    folded = F.udf(pytasks.nfkc_text, "string", useArrow=True)
    ascii_only = c.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(F.when(ascii_only, c), folded(F.when(~ascii_only, c)))


def st_name(normalized: Column) -> Column:
    """Leading ST / *ST marker test on an NFKC name."""
    return F.trim(normalized).rlike(r"(?i)^\*?ST")


def normalized_name(nfkc_name: Column) -> Column:
    """Comparison form of an NFKC name: spaces removed, upper case."""
    return F.upper(F.replace(nfkc_name, F.lit(" "), F.lit("")))


def decode_entities(c: Column) -> Column:
    """Decode the five named entities and numeric references in one pass."""
    decoded = F.udf(pytasks.entity_text, "string", useArrow=True)
    named = c
    for entity, char in ENTITIES.items():
        named = F.replace(named, F.lit(entity), F.lit(char))
    # An ampersand entity may create new entity text, so only single-level
    # lower-case named entities are safe to replace on the JVM side.
    simple = ~c.rlike(r"&#") & ~c.rlike(r"&amp;[A-Za-z]+;") & ~c.rlike(r"&[a-z]*[A-Z]")
    jvm = F.when(~c.contains("&"), c).when(simple, named)
    return F.coalesce(jvm, decoded(F.when(jvm.isNull(), c)))


def search_text_ok(c: Column) -> Column:
    """1..40 characters of Han, alphanumerics, space, `*`, dots or hyphen."""
    text = F.trim(c)
    return (F.length(text).between(1, 40)) & text.rlike(r"^[\p{IsHan}A-Za-z0-9 *．.\-]+$")


def canonical_json(c: Column) -> Column:
    """JSON text with object keys in sorted order."""
    return F.to_json(F.parse_json(c))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def composite_key(*parts: Column) -> Column:
    """JSON array of key parts as one text key; NULL parts stay visible."""
    return F.to_json(F.array(*[p.cast("string") for p in parts]))

"""Rules on document types, field values and names as Column -> Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import tables as V


def _has(c: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a & b, [c.contains(p) for p in parts])


def _any(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in parts])


def normalize_doc_type(raw: Column) -> Column:
    """The document type that a free answer names; the first rule that holds wins, null and others UNRECOGNIZED."""
    t = F.lower(F.trim(raw))
    # What names which type, the first that holds.
    rules = [(_has(t, "1099", word), f"1099-{word.upper()}") for word in ("nec", "int", "misc", "div")]
    rules += [(t.rlike(rf"1099[\s\-]?{x}\b"), f"1099-{x.upper()}") for x in "rgb"]
    rules += [
        (t.rlike(r"1098[\s\-]?t\b") | t.contains("tuition"), "1098-T"),
        (t.rlike(r"1098[\s\-]?e\b") | t.contains("student loan"), "1098-E"),
        (t.contains("1098"), "1098"),
        (t.contains("1095"), "1095-A"),
        (t.rlike(r"\bw[\s\-]?2\b") | t.contains("wage and tax"), "W-2"),
        (t.rlike(r"\bw[\s\-]?9\b") | t.contains("request for taxpayer identification"), "W-9"),
        (t.rlike(r"\bk[\s\-]?1\b") | t.contains("schedule k"), "K-1"),
        (t.contains("property tax"), "property tax statement"),
        (_any(t, ["charitable", "donation receipt", "donation acknowledg"]), "charitable receipt"),
        (_any(t, ["brokerage", "consolidated 1099"]), "brokerage statement"),
        (t.contains("engagement"), "engagement letter"),
    ]
    chain = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        chain = chain.when(test, name)
    return chain.otherwise(V.UNRECOGNIZED)


def is_money_key(key: Column) -> Column:
    return _any(F.lower(key), V.MONEY_TOKENS)


def is_tin_key(key: Column) -> Column:
    k = F.lower(key)
    return (k == "ssn") | k.contains("tin") | k.contains("ein")


def is_name_field(key: Column) -> Column:
    return ~is_money_key(key) & ~is_tin_key(key)


def parse_money(value: Column) -> Column:
    """A display amount as double, null where it is none. Digit groups may hold single underscores, as in code."""
    bare = F.regexp_replace(F.regexp_replace(value, r"[,$\s]", ""), r"(?<=\d)_(?=\d)", "")
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    word = r"(?i)^[+-]?(inf|infinity|nan)$"
    return F.when(bare.rlike(number) | bare.rlike(word), bare.try_cast("double"))


def field_format_ok(key: Column, value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    k = F.lower(key)
    digits = F.length(F.regexp_replace(v, r"\D", ""))
    return (
        F.when(v == "", False)
        .when(k == "ssn", v.rlike(r"^\d{3}-?\d{2}-?\d{4}$"))
        .when(k.contains("tin") | k.contains("ein"), digits == 9)
        .when(is_money_key(key), parse_money(v).isNotNull())
        .otherwise(True)
    )


def field_low_confidence(key: Column, value: Column, retried: Column) -> Column:
    return F.coalesce(retried, F.lit(False)) | ~field_format_ok(key, value)


def correction_category(key: Column) -> Column:
    return F.when(_any(F.lower(key), V.CATEGORY_MONEY_TOKENS), "money").when(is_tin_key(key), "tin_ssn").otherwise("names")


def norm_string(value: Column) -> Column:
    """Punctuation as space, white space runs as one, trimmed, folded (the German sharp s as ss)."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")
    return F.replace(F.lower(F.trim(bare)), F.lit("ß"), F.lit("ss"))


def label_phrases() -> list[str]:
    """The normalised labels that a model must not return as a value."""
    import re

    found = [" ".join(re.sub(r"[^\w\s]", " ", x).split()).casefold() for x in [r[3] for r in V.REGIONS] + V.ROLE_PHRASES]
    return sorted({*found})


def looks_like_label(value: Column, phrases: list[str] | None = None) -> Column:
    """Blank, a label, or for labels of several words contained in one or containing one."""
    phrases = label_phrases() if phrases is None else phrases
    v = norm_string(F.coalesce(value, F.lit("")))
    several = [p for p in phrases if " " in p]
    # normalised values hold no line breaks: one search for "in a label", one pattern for "holds a label"
    return (v == "") | v.isin(phrases) | F.lit("\n".join(several)).contains(v) | v.rlike("|".join(several))


def fields_agree(key: Column, a: Column, b: Column) -> Column:
    x, y = F.trim(F.coalesce(a, F.lit(""))), F.trim(F.coalesce(b, F.lit("")))
    near = F.coalesce(F.abs(parse_money(x) - parse_money(y)) <= 0.01, F.lit(False))
    return F.when((x == "") | (y == ""), False).when(is_money_key(key), near).otherwise(norm_string(x) == norm_string(y))


def coerce_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "yes", "1", "handwritten"), F.lit(False))


def slugify(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("client"))


def page_number(value: Column) -> Column:
    """A whole number of 1 or more from a number or digits, null for anything else (also true and false)."""
    v = F.trim(value)
    n = F.when(v.rlike(r"^\+?\d+(\.0+)?$"), F.regexp_replace(v, r"^\+|\.0+$", "").try_cast("int"))
    return F.when(n >= 1, n)


def is_money_label(expected: Column) -> Column:
    return expected.rlike(r"^\$?\s*[\d,]+(?:\.\d+)?\s*$")


def score_field(expected: Column, predicted: Column) -> Column:
    """missing, correct or wrong; amounts within a cent, other values by their normalised form."""
    blank = F.trim(F.coalesce(predicted, F.lit(""))) == ""
    a, b = parse_money(expected), parse_money(predicted)
    money = F.coalesce((a - b >= -0.01) & (a - b <= 0.01), F.lit(False))
    right = F.when(is_money_label(expected), money).otherwise(norm_string(expected) == norm_string(predicted))
    return F.when(blank, "missing").when(right, "correct").otherwise("wrong")


def mask_tin(value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    short = F.coalesce(F.nullif(value, F.lit("")), F.lit("—"))
    return F.when(F.coalesce(F.length(digits), F.lit(0)) < 4, short).otherwise(F.concat(F.lit("•••-••-"), F.right(digits, F.lit(4))))


def money_display(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "—").otherwise(F.concat(F.lit("$"), value))


def file_size(n: Column) -> Column:
    tenths = F.floor(n * 10 / F.lit(1024 * 1024) + 0.5) / 10
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", tenths), F.lit(" MB")))
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def is_eligible(name: Column, extensions: list[str]) -> Column:
    """A plain file name with one of the extensions, hidden names out."""
    return ~name.startswith(".") & extension(name).isin(extensions)


def image_like(content: Column) -> Column:
    """Whether bytes begin as a PNG, JPEG or WebP image does."""
    head = F.hex(F.substring(content, 1, 12))
    return F.coalesce(head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | (head.startswith("52494646") & head.endswith("57454250")), F.lit(False))


def parse_timestamp(value: Column) -> Column:
    return F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def parse_json(text: Column) -> Column:
    """The outermost object of a model's answer as text, fences off; null if it holds none that parses."""
    s = F.trim(text)
    fenced = F.regexp_extract(s, r"(?s)^```[a-zA-Z]*\s*(.*?)\s*```$", 1)
    s = F.when(fenced != "", fenced).otherwise(s)
    start, rest = F.instr(s, "{"), F.instr(F.reverse(s), "}")
    snippet = F.when((start > 0) & (rest > 0), F.substr(s, start, F.length(s) - rest + 2 - start))
    # in the strict mode Spark's parser fails where a key is repeated or the object is cut off
    return F.when(F.try_parse_json(snippet).isNotNull(), snippet)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bigint fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(values: Column, n: int = 64) -> Column:
    """n - 1 bits of a numeric array: bit i is set where element i is over element i + 1."""
    bits = [F.when(F.element_at(values, i + 1) > F.element_at(values, i + 2), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(n - 1)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def wide_hash(bits: Column, n: int = 4) -> Column:
    """64 n booleans (array) as an array of n bigint words, the first the highest bit of the first word."""
    word = lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), F.lit(0).cast("bigint"), lambda x, b: F.shiftleft(x, 1).bitwiseOR(F.coalesce(b, F.lit(False)).cast("bigint")))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word)


def grid_hash(cells: Column, rows: int = 16, columns: int = 16) -> Column:
    """The difference hash of a grid of rows x (columns + 1) cells: a bit is set where a cell is over the next one."""
    at = lambda i: F.floor(i / columns).cast("int") * (columns + 1) + i % columns
    bits = F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda i: F.get(cells, at(i)) > F.get(cells, at(i) + 1))
    return wide_hash(bits, rows * columns // 64)


def hash_digits(words: Column, n: int = 4) -> Column:
    """The words as 16 hex digits each."""
    return F.concat(*[F.lower(F.lpad(F.hex(words[k]), 16, "0")) for k in range(n)])


def words_of_digits(digits: Column, n: int = 4) -> Column:
    """Words from hex digits; null unless there are 16 for each."""
    parts = [F.conv(F.substring(digits, 16 * k + 1, 16), 16, -10).cast("bigint") for k in range(n)]
    return F.when(digits.rlike(f"^[0-9a-fA-F]{{{16 * n}}}$"), F.array(*parts))


def wide_hamming(a: Column, b: Column, n: int = 4) -> Column:
    """Differing bits of two fingerprints of n words."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(n)])


def wide_band(fp: Column, k: int, bands: int, n: int = 4) -> Column:
    """The k-th of ``bands`` runs of bits of n words, numbered from the lowest bit of the first word; of runs over 64 bits a hash."""
    first, last = k * 64 * n // bands, (k + 1) * 64 * n // bands
    parts, at = [], first
    while at < last:
        word, low = divmod(at, 64)
        width = min(64 - low, last - at)
        part = F.shiftrightunsigned(fp[word], low)
        parts.append((part if width == 64 else part.bitwiseAND(F.lit((1 << width) - 1)), at - first))
        at += width
    if last - first > 64:
        return F.xxhash64(*[p for p, _ in parts])
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(p, shift) for p, shift in parts])


def nudge_ok(draft: Column, name: Column, missing: Column, most: int = V.NUDGE_MAX_CHARS) -> Column:
    return (
        (F.coalesce(draft, F.lit("")) != "") & (F.length(draft) <= most) & ~draft.contains("[")
        & ((F.coalesce(name, F.lit("")) == "") | draft.contains(name)) & F.forall(missing, lambda m: draft.contains(m))
    )


def nudge_template(name: Column, missing: Column) -> Column:
    one = F.size(missing) == 1
    # The wording of the reminder.
    return F.concat(
        F.lit("Hi "), name, F.lit(",\n\nAs we prepare your tax return, we're still missing the following document"), F.when(one, "").otherwise("s"), F.lit(":\n\n"),
        F.array_join(F.transform(missing, lambda m: F.concat(F.lit("- "), m, F.lit("\n"))), ""),
        F.lit("\nCould you send "), F.when(one, "this").otherwise("these"), F.lit(" over when you have a moment?\n\nThank you."),
    )


def encode_component(text: Column) -> Column:
    """Percent-encoding as mail links have it: spaces as %20, and !'()~ as they are."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def derive_seed(*parts: Column) -> Column:
    """16 hex digits of the parts' hash as a whole number (decimal text)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10)

"""Text functions as column expressions. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}\x85\x1c-\x1f]+"
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def trim_space(c: Column) -> Column:
    """Trim all Unicode white space, which F.trim does not."""
    return F.regexp_replace(F.regexp_replace(c, "^" + _SPACE, ""), _SPACE + "$", "")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank, trimmed; else the empty string."""
    return F.coalesce(*(F.nullif(trim_space(c), F.lit("")) for c in columns), F.lit(""))


def tokenize(c: Column) -> Column:
    """Lower-case words; runs of CJK characters become overlapping pairs (a single one stands alone). Texts without CJK characters are split by one pattern alone."""
    low = F.lower(c)
    runs = F.regexp_extract_all(low, F.lit(rf"[{_CJK}]+|[\p{{L}}\p{{Nd}}&&[^{_CJK}]]+"), F.lit(0))

    def split(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(f"^[{_CJK}]") & (F.char_length(run) > 1), pairs).otherwise(F.array(run))

    return F.when(c.rlike(f"[{_CJK}]"), F.flatten(F.transform(runs, split))).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))


def normalize_text(c: Column) -> Column:
    """CRLF to LF, no blanks at line ends, trimmed, at most one blank line in a row."""
    unix = F.regexp_replace(c, "\r\n", "\n")
    return F.regexp_replace(trim_space(F.regexp_replace(unix, r"[ \t]+(?=\n|$(?!\n))", "")), r"\n{3,}", "\n\n")


def content_sha(c: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(normalize_text(c), 256), 1, 16)


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as an unsigned 32-bit number. Meant for short strings: it folds byte by byte."""
    digits = F.hex(F.encode(c, "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits), F.lit(2))).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def short_hash(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(fnv1a32(c)), 8, "0"))


def collection_number(c: Column) -> Column:
    return fnv1a32(c) % 100000


def content_id(collection: Column, text: Column) -> Column:
    """The first 64 bits of the SHA-256 of collection, NUL and normalised text, as an unsigned decimal string."""
    return F.conv(F.substring(F.sha2(F.concat(collection, F.lit("\0"), normalize_text(text)), 256), 1, 16), 16, 10)


def clean_list(tags: Column) -> Column:
    """Trimmed, without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(tags, trim_space), lambda t: t != ""))


def expand_tags(tags: Column) -> Column:
    """Every tag and its ancestors (a, a/b, a/b/c), without leading #, in order of first appearance."""
    bare = F.filter(F.transform(tags, lambda t: trim_space(F.regexp_replace(trim_space(t), "^#+", ""))), lambda t: t != "")

    def closure(tag: Column) -> Column:
        parts = F.filter(F.transform(F.split(tag, "/", -1), trim_space), lambda p: p != "")
        return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(bare, closure)))


def tags_text(tags: Column) -> Column:
    """Tags as words for keyword search."""
    return F.translate(F.concat_ws(" ", tags), "/,", "  ")


def parse_tags(c: Column) -> Column:
    """A comma-separated string as a list of tags."""
    return F.filter(F.transform(F.split(c, ",", -1), lambda t: F.regexp_replace(trim_space(t), "^#", "")), lambda t: t != "")


def truncate_runes(c: Column, limit: int) -> Column:
    """The first ``limit`` characters and an ellipsis; no limit if it is not positive."""
    return c if limit <= 0 else F.when(F.char_length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def _strip(c: Column, chars: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^[{chars}]+", ""), f"[{chars}]+$", "")


def sanitize_segment(c: Column) -> Column:
    """A lower-case path segment of [a-z0-9._-], at most 40 long."""
    return _strip(F.substring(_strip(F.regexp_replace(F.lower(trim_space(c)), "[^a-z0-9._-]+", "-"), r"\-."), 1, 40), r"\-.")


def doc_slug(title: Column, url: Column) -> Column:
    """The readable part of a file name: from the title, else the last URL segment, else "document"."""
    path = _strip(F.regexp_replace(F.regexp_replace(trim_space(F.coalesce(url, F.lit(""))), "^.*?://", ""), r"[?#][\s\S]*$", ""), "/")
    base = first_filled(title, F.element_at(F.split(path, "/", -1), -1), F.lit("document"))
    dashed = F.regexp_replace(F.translate(base, _UPPER, _LOWER), r"[^a-z0-9\x{3001}-\x{10FFFF}]", "-")
    return first_filled(_strip(F.substring(first_filled(_strip(dashed, r"\-."), F.lit("document")), 1, 48), r"\-."), F.lit(""))


def safe_key(source: Column, root: str = "") -> Column:
    """A path whose segments are safe; a hash is added if anything had to change. Text without a source is "direct_text"."""
    bare = trim_space(source)
    inside = F.when(bare.startswith(root.rstrip("/") + "/"), F.substring(bare, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(bare) if root else bare
    path = F.regexp_replace(inside, "^/", "")

    def segment(p: Column) -> Column:
        return F.substring(first_filled(_strip(F.regexp_replace(p, "[^A-Za-z0-9._-]+", "_"), "._ "), F.lit("_")), 1, 80)

    key = F.array_join(F.transform(F.split(path, "/", -1), segment), "/")
    return F.when((bare == "") | (bare == "direct_text"), "direct_text").when(key == path, key).otherwise(F.concat(key, F.lit("__"), short_hash(path)))


def title_from_text(c: Column) -> Column:
    """The first line that holds more than heading marks, without them, at most 80 characters."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: trim_space(F.regexp_replace(trim_space(x), r"^[#>\-* \t]+", "")))
    return F.substring(F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit("")), 1, 80)


_FRONT = r"^\x{FEFF}?---\r?\n(?:(?![ \t]*---[ \t]*\r?\n)[^\n]*+\n)*+[ \t]*---[ \t]*\r?\n"


def strip_front_matter(c: Column) -> Column:
    """The text after a leading block between --- lines; the whole text if there is none."""
    return F.regexp_replace(c, _FRONT, "")


def has_front_matter(c: Column) -> Column:
    return c.rlike(_FRONT)


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def looks_binary(content: Column) -> Column:
    """A NUL among the first 8000 bytes."""
    return F.locate("\0", F.decode(F.substring(content, 1, 8000), "ISO-8859-1")) > 0

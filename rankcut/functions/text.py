"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # the 32 ASCII signs (fixed list)
PRICE = r"\$?([\d,]+(?:\.\d{1,2})?)"
PRICE_TERMS = r"(?i)\$|price|under|over|less than|more than|cheap|expensive"


def parse_price(raw: Column) -> Column:
    """First number in the text; NULL if there is none or it isn't within (0, 100000]."""
    value = F.regexp_replace(F.regexp_extract(raw, PRICE, 1), ",", "").try_cast("double")
    return F.when((value > 0) & (value <= 100000), value)


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def joined(parts: Column) -> Column:
    """An array's strings with blanks between; NULL counts as no strings."""
    return F.array_join(F.coalesce(parts, F.array().cast("array<string>")), " ")


def passes_content(title: Column, description: Column, features: Column, least: int = 30) -> Column:
    """A title that isn't blank, and enough words in all."""
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (word_count(F.concat_ws(" ", title, joined(description), joined(features))) >= least)


def document_text(title: Column, description: Column, features: Column, price: Column | None = None) -> Column:
    body = F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), joined(description), F.lit(" "), joined(features)))
    return body if price is None else F.concat(body, F.when(price.isNotNull(), F.format_string(" Price: $%.2f.", price)).otherwise(""))


def category_path(categories: Column, level: int = 2) -> Column:
    """The first level + 1 names, joined by " > "; NULL if there are no more than `level`."""
    return F.when(F.size(categories) > level, F.array_join(F.slice(categories, 1, level + 1), " > "))


def short_id(key: Column) -> Column:
    return F.substring(F.md5(key.cast("string")), 1, 12)


def query_slug(category: Column, prefix: str = "q", most: int = 70, suffix: Column | None = None) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(category), r" > | ", "_"), r"[^a-z0-9_]", "")
    slug = F.concat(F.lit(f"{prefix}_"), F.substring(slug, 1, most))
    return slug if suffix is None else F.concat(slug, F.lit("_"), suffix)


def title_of(text: Column, most: int = 100) -> Column:
    """What stands before the first ". ", unless that begins the text; cut and trimmed."""
    at = F.locate(". ", text)
    return F.trim(F.substring(F.when(at > 1, F.substring_index(text, ". ", 1)).otherwise(text), 1, most))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def normal_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normal_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and articles."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"\s+", " "))


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(normal_answer(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def split_titles(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), normal_title), lambda t: t != "")


def query_flags(text: Column) -> dict[str, Column]:
    return {"n_words": word_count(text), "has_digit": text.rlike("[0-9]"), "has_price_term": text.rlike(PRICE_TERMS)}


def k_range(k: Column) -> Column:
    return F.when(k <= 5, "2-5").when(k <= 10, "6-10").when(k <= 15, "11-15").otherwise("16-20")


def bucket_of(k: Column, buckets: list[tuple[str, int, int]]) -> Column:
    """Name of the first bucket (name, from, to) that holds k."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(buckets):
        out = F.when(k.between(lo, hi), name).otherwise(out)
    return out


def price_question(category: Column, direction: Column, threshold: Column, templates: list[str], nth: Column) -> Column:
    """The nth template (from 0, in turn) filled with category, direction and threshold (%1$s, %2$s, %3$.2f)."""
    out = None
    for i, t in enumerate(templates):
        filled = F.format_string(t, category, direction, threshold)
        out = F.when(nth % len(templates) == i, filled) if out is None else out.when(nth % len(templates) == i, filled)
    return out


def json_of(raw: Column, schema: str) -> Column:
    """JSON from a model's output: the whole of it, a fenced block marked json, any fenced block, or what lies between the
    first brace and the last."""
    whole = F.when(F.trim(raw).rlike(r"^(?s)\{.*\}$"), F.trim(raw))
    pick = lambda p: F.when(F.regexp_extract(raw, p, 1) != "", F.regexp_extract(raw, p, 1))
    found = [whole, pick(r"(?s)```json\s*(\{.*?\})\s*```"), pick(r"(?s)```\s*(\{.*?\})\s*```"), pick(r"(?s)(\{.*\})")]
    return F.coalesce(*(F.from_json(x, schema) for x in found))


def question_errors(question: Column) -> Column:
    """What is wrong with a generated question, as a list."""
    n = word_count(question)
    return F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "empty"),
            F.when(~F.rtrim(F.coalesce(question, F.lit(""))).endswith("?"), "no question mark"),
            F.when((n < 10) | (n > 60), "length"),
        )
    )


def domain_tags(text: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """Names of the domains of which a keyword stands in the text, or the default."""
    low = F.lower(text)
    found = F.array_compact(F.array(*(F.when(low.rlike("|".join(map(_quoted, words_))), name) for name, words_ in keywords.items())))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)

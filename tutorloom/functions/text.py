"""Text functions as Catalyst expressions over string columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
# Whitespace as Unicode defines it, written so that Java and RE2 read the same class.
SPACE_SET = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE_CLASS = f"[{SPACE_SET}]"
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # the members of the class
URL_PATTERN = rf"https?://[^{SPACE_SET}]+|www\.[^{SPACE_SET}]+"
UNIFIED_SPACE_PATTERN = r"[\x{A0}\x{2000}-\x{206F}]"
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
TAG_PATTERN = r"<[^>]+>"
TEXT_FIELDS = ["text", "content", "description", "body", "article", "document"]
ENGLISH_STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below "
    "between both but by can cannot could did do does doing down during each else ever every few for "
    "from further had has have having he her here hers herself him himself his how i if in into is it "
    "its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them themselves "
    "then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your yours yourself yourselves"
).split()
LANGUAGE_WORDS = {
    "en": "the of and to in is that it was for on are with as this be at by from or have not they which you were".split(),
    "fr": "le la les de des un une et est que qui dans pour par sur pas au avec ce il elle nous vous ou".split(),
    "de": "der die das und ist nicht ein eine zu den mit von auf für im dem sich auch als an es ich wird".split(),
    "es": "el los las que y en un una es por con para del se no lo al como más su sus o pero".split(),
}
NAME_STOP_WORDS = "the and or but in on at to for of with by an a".split()
# -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CleaningConfig:
    """Switches and limits of document preparation."""

    remove_urls: bool = True
    remove_emails: bool = True
    remove_html: bool = True
    normalize_unicode: bool = True
    lowercase: bool = True
    min_words: int = 10
    max_words: int = 50_000
    max_word_length: int = 50
    max_number_ratio: float = 0.5
    language_detection: bool = True
    allowed_languages: tuple[str, ...] = ("en",)
    remove_duplicates: bool = True
    duplicate_threshold: float = 0.95


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(text: Column) -> Column:
    """Strip Unicode whitespace on both sides (``trim`` knows the space character only)."""
    return F.btrim(text, F.lit(SPACES))


def collapse_space(text: Column) -> Column:
    """Runs of Unicode whitespace become one space; both ends trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def clean_text(text: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    """Strip links, addresses and tags, unify spaces, lowercase. Null becomes the empty string."""
    out = F.coalesce(text, F.lit(""))
    if cfg.remove_urls:
        out = F.regexp_replace(out, URL_PATTERN, "")
    if cfg.remove_emails:
        # (?U) gives the word boundaries their Unicode meaning
        out = F.regexp_replace(out, "(?U)" + EMAIL_PATTERN, "")
    if cfg.remove_html:
        out = F.regexp_replace(out, TAG_PATTERN, "")
    if cfg.normalize_unicode:
        out = F.regexp_replace(out, UNIFIED_SPACE_PATTERN, " ")
    if cfg.lowercase:
        out = F.lower(out)
    return collapse_space(out)


def words(text: Column) -> Column:
    """Whitespace-separated words, empties dropped."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def array_join_words(text: Column, n: int) -> Column:
    """First ``n`` words joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def number_ratio(word_array: Column) -> Column:
    digits = F.size(F.filter(word_array, lambda w: w.rlike(r"^\p{Nd}+$")))
    return F.try_divide(digits, F.size(word_array))


def quality_reason(text: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    """First failing rule, or ``quality``."""

    def verdict(ws: Column) -> Column:
        n = F.size(ws)
        out = F.when(n < cfg.min_words, "too_short").when(n > cfg.max_words, "too_long")
        out = out.when(F.exists(ws, lambda w: F.length(w) > cfg.max_word_length), "long_words")
        if cfg.max_number_ratio < 1.0:
            out = out.when(number_ratio(ws) > cfg.max_number_ratio, "too_many_numbers")
        return out.otherwise("quality")

    return let(words(text), verdict)


def quality_label(text: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    """The reason with its number, e.g. ``too_short_7_words``."""
    measures = F.struct(
        quality_reason(text, cfg).alias("reason"),
        let(words(text), lambda ws: F.struct(F.size(ws).alias("n"), number_ratio(ws).alias("ratio"))).alias("m"),
    )

    def label(x: Column) -> Column:
        return (
            F.when(x["reason"].isin("too_short", "too_long"), F.format_string("%s_%d_words", x["reason"], x["m"]["n"]))
            .when(x["reason"] == "long_words", "long_words_found")
            .when(x["reason"] == "too_many_numbers", F.format_string("too_many_numbers_%.2f", F.bround(x["m"]["ratio"], 2)))
            .otherwise(x["reason"])
        )

    return let(measures, label)


def detect_language(text: Column) -> Column:
    """Language whose common words occur most often; ``unknown`` when none occurs."""

    def hits(tokens: Column, known: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(known)))

    def best(tokens: Column) -> Column:
        scores = [
            F.struct(hits(tokens, known).alias("hits"), F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
            for i, (lang, known) in enumerate(LANGUAGE_WORDS.items())
        ]
        return F.array_max(F.array(*scores))

    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
    return let(let(tokens, best), lambda b: F.when(b["hits"] > 0, b["lang"]).otherwise("unknown"))


def language_allowed(lang: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    if not cfg.language_detection or not cfg.allowed_languages:
        return F.lit(True)
    return lang.isin(*cfg.allowed_languages)


def prepared_document(text: Column, cfg: CleaningConfig = CleaningConfig()) -> Column:
    """Cleaned text of one document, null when quality or language rejects it."""

    def kept(cleaned: Column) -> Column:
        ok = (quality_reason(cleaned, cfg) == "quality") & language_allowed(detect_language(cleaned), cfg)
        return F.when(ok, cleaned)

    return let(clean_text(text, cfg), kept)


def first_filled(*cols: Column, min_words: int = 1) -> Column:
    """First column holding at least ``min_words`` words, trimmed; null when none does."""
    tests = []
    for c in cols:
        trimmed = trim_space(F.coalesce(c, F.lit("")))
        tests.append(let(trimmed, lambda t: F.when((t != "") if min_words == 1 else word_count(t) >= min_words, t)))
    return F.coalesce(*tests)


def topic_input(text: Column, max_chars: int | None = None, min_ratio: float = 0.7) -> Column:
    """Guard before topic discovery: null for fewer than 3 words or mostly symbol text; ``max_chars`` cuts longer texts."""
    cut = F.substring(text, 1, max_chars) if max_chars is not None else text
    kept = F.length(F.regexp_replace(cut, r"[^\p{L}\p{N}\s.,!?;:]", ""))
    ok = (word_count(text) >= 3) & (F.try_divide(kept, F.length(cut)) >= min_ratio)
    return F.when(ok, collapse_space(cut))


def truncate(text: Column, limit: int, keep: int | None = None) -> Column:
    """Cut long text to ``keep`` characters and append an ellipsis."""
    keep = limit if keep is None else keep
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def preview(text: Column) -> Column:
    return truncate(text, 100)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, as ``str.title`` (``initcap`` splits on spaces only)."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)


    def capital(p: Column) -> Column:
        # the capital of one letter may be two ("ß"), of which only the first stays large
        first = F.upper(F.substring(p, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 2)), F.lower(F.substring(p, 2, 1 << 30)))

    return F.array_join(F.transform(parts, capital), "")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


# File kinds by extension.
FILE_KINDS = {
    "code": ["py", "js", "ts", "html", "css", "json", "xml"],
    "markdown": ["md", "markdown"],
    "text": ["txt"],
    "pdf": ["pdf"],
    "image": ["jpg", "jpeg", "png", "gif"],
}


def file_kind(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    out = F.lit("text")
    for kind, exts in FILE_KINDS.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def human_size(size: Column) -> Column:
    """1024-based size with at most two decimals, trailing zeros dropped."""
    units = F.array(*[F.lit(u) for u in ("Bytes", "KB", "MB", "GB")])
    step = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    number = F.format_string("%.2f", size / F.pow(F.lit(1024.0), step))
    plain = F.regexp_replace(F.regexp_replace(number, r"0+$", ""), r"\.$", "")
    return F.when(size == 0, "0 Bytes").otherwise(F.concat_ws(" ", plain, F.element_at(units, step + 1)))


def match_context(line: Column, needle: str, around: int = 50) -> Column:
    """Text within ``around`` characters of the first hit, dots marking the cut sides."""
    at = F.locate(needle.lower(), F.lower(line)) - 1
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(line), at + len(needle) + around)
    body = trim_space(F.substring(line, start + 1, end - start))
    return F.concat(
        F.when(start > 0, "...").otherwise(""), body, F.when(end < F.length(line), "...").otherwise("")
    )


def percent_text(value: Column, digits: int) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", F.bround(value * 100, digits)), F.lit("%"))


def sentences(text: Column) -> Column:
    """Text between full stops, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(text, r"\."), trim_space), lambda s: s != "")


def word_tokens(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def one_and_two_grams(tokens: Column) -> Column:
    """Tokens followed by the pairs of neighbouring tokens."""


    def grams(t: Column) -> Column:
        n = F.size(t)
        shifted = F.slice(t, 2, F.greatest(n - 1, F.lit(0)))
        pairs = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), shifted, lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(t, pairs)

    return let(tokens, grams)


def content_words(text: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    """Tokens without stop words."""
    return F.filter(word_tokens(text), lambda t: ~t.isin(stop_words))


def terms(text: Column, stop_words: list[str] = ENGLISH_STOP_WORDS) -> Column:
    """1-2-gram terms without stop words."""
    return one_and_two_grams(content_words(text, stop_words))


def generation_prompt(content: Column, count: int, question_types: list[str] | None = None, difficulty: Column | None = None, max_chars: int | None = None) -> Column:
    """Prompt asking a text generator for questions on a text, or on its first ``max_chars`` characters."""
    kinds = ", ".join(question_types) if question_types else "multiple choice, true/false, short answer"
    level = F.concat(F.lit(" at "), difficulty, F.lit(" difficulty level")) if difficulty is not None else F.lit("")
    return F.concat(
        F.lit(f"Write {count} varied quiz questions"), level,
        F.lit(f" about the content below.\nAllowed question types: {kinds}\nContent:\n"),
        F.substring(content, 1, max_chars) if max_chars is not None else content,
        F.lit('\nAnswer with a JSON array of objects with the keys "question", "type", "answer", "options", "explanation", "confidence".'),
    )


QUESTION_SCHEMA = "array<struct<question:string,type:string,answer:string,options:array<string>,explanation:string,confidence:double>>"


def parse_questions(response: Column) -> Column:
    """Array of question structs found in free text; empty when nothing parses."""
    inner = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    parsed = F.from_json(F.when(inner != "", inner).otherwise(response), QUESTION_SCHEMA)
    usable = F.filter(parsed, lambda q: q["question"].isNotNull() & q["answer"].isNotNull())
    filled = F.transform(
        usable,
        lambda q: q.withField("type", F.coalesce(q["type"], F.lit("multiple_choice"))).withField(
            "confidence", F.coalesce(q["confidence"], F.lit(0.8))
        ),
    )
    return F.coalesce(filled, F.array().cast(QUESTION_SCHEMA))


VERDICT_SCHEMA = "relationship_type string, strength double, reasoning string, direction string"


def parse_verdict(response: Column) -> Column:
    """Struct from the JSON object inside free text; null when absent or unparsable."""
    return F.from_json(F.regexp_extract(response, r"(?s)(\{.*\})", 1), VERDICT_SCHEMA)

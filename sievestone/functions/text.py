"""Text, hash and score expressions: native Columns, but for the votes of a SimHash."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache, reduce
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from . import constants as C


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: within a lambda, an outer expression would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    """md5 of the lower-cased text with white space collapsed."""
    return F.md5(collapsed(F.lower(text)).cast("binary"))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def normalized_title(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(title)), r"[^a-z0-9\s]", ""), r"\s+", " ")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 where either is empty."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when((F.size(x.a) > 0) & (F.size(x.b) > 0), F.size(F.array_intersect(x.a, x.b)) / F.size(F.array_union(x.a, x.b))).otherwise(F.lit(0.0)))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normalized_title(title), " "), ""))


def char_ngrams(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams of the lower-cased text with white space collapsed (but not trimmed).

    The text is cut into characters once: a substring is counted from the text's start, which is quadratic in its length."""
    gram = lambda c, i: F.concat(*[F.get(c, i + k) for k in range(n)])
    grams = lambda c: F.when(F.size(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: gram(c, i)))).otherwise(F.expr("array()").cast("array<string>"))
    return bound(F.split(F.regexp_replace(F.lower(text), r"\s+", " "), ""), grams)


def gram_similarity(text: Column, asked: str, n: int = 4) -> Column:
    """jaccard() of the char_ngrams() of each text with those of one short string.  Text is folded natively; slices are cut in an Arrow UDF."""
    folded = lambda t: F.regexp_replace(F.lower(t), r"\s+", " ")

    @F.arrow_udf(DoubleType())
    def share(texts: pa.Array, short: pa.Array) -> pa.Array:
        cut = lambda t: {t[i : i + n] for i in range(len(t) - n + 1)}
        wanted, out = cut(short[0].as_py()) if len(short) else set(), []
        for t in texts:
            has = None if (t := t.as_py()) is None else cut(t)
            out.append(None if has is None else len(has & wanted) / len(has | wanted) if has and wanted else 0.0)
        return pa.array(out, pa.float64())

    return share(folded(text), folded(F.lit(asked)))


def report_tokens(text: Column) -> Column:
    """Words of four a-z or more in the first 5,000 characters, without English stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.substring(text, 1, 5000)), F.lit("[a-z]{4,}"), 0), lambda w: ~w.isin(C.STOP_WORDS))


def ranking_tokens(text: Column) -> Column:
    """Unicode words of three characters or more without stop words of four languages, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), 0), lambda w: ~w.isin(C.RANKING_STOP_WORDS))


#: Characters of a text that a SimHash is made of where nothing else is asked for.
HEAD = 8000


def _dedup_text(text: Column, head: int | None = HEAD) -> Column:
    return F.regexp_replace(F.lower(text if head is None else F.substring(text, 1, head)), r"[^a-z0-9\s]", " ")


def dedup_tokens(text: Column) -> Column:
    """Words of the first 8,000 characters and pairs of neighbours."""
    none = F.expr("array()").cast("array<string>")
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit("_"), b))).otherwise(none)
    return bound(F.array_remove(F.split(_dedup_text(text), r"\s+"), ""), lambda w: F.concat(w, pairs(w)))


@lru_cache(maxsize=1 << 17)
def _token_hash(token: str) -> bytes:
    return hashlib.md5(token.encode()).digest()[8:]


#: Words of a text whose bits are summed at a time; whole texts that go to Python at a time.
WORDS, TEXTS = 1 << 13, 512


@F.arrow_udf(LongType())
def _majority(texts: pa.Array) -> pa.Array:
    """The bits that most md5s of the words and neighbouring pairs of each text have set.  Texts are made into objects one at a time."""
    out = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = (text.as_py() or "").split()
        if not words:
            continue
        set_ = np.zeros(64, np.int64)
        for low in range(0, len(words), WORDS):
            some = words[low : low + WORDS + 1]  # the last one begins the next part
            digests = b"".join([*map(_token_hash, some[:WORDS]), *(_token_hash(f"{a}_{b}") for a, b in zip(some, some[1:], strict=False))])
            set_ += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out[k] = np.packbits(2 * set_ > 2 * len(words) - 1).view(">i8")[0]
    return pa.array(out)


def simhash(df: DataFrame, key: str, text: str, out: str = "simhash", head: int | None = HEAD) -> DataFrame:
    """(key, out): 64-bit SimHash by the low 64 bits of md5 of each of the dedup tokens.  Texts without tokens have 0.

    One row for each row of df, nothing is shuffled: characters are cleaned natively, and votes are summed in an Arrow UDF,
    to which the first `head` characters go, or whole texts with None."""
    return df.select(F.col(key), _majority(_dedup_text(F.col(text), head)).alias(out))


def simhash_hex(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64


def published(date: Column) -> Column:
    return F.try_to_date(F.substring(date, 1, 10), "yyyy-MM-dd")


def age_days(date: Column, as_of: Column) -> Column:
    return F.datediff(as_of, published(date))


def decay(date: Column, as_of: Column, missing: float) -> Column:
    """exp(-age / 43.3) of a date, `missing` where there is none (the report takes 0, research 0.3)."""
    age = age_days(date, as_of)
    return F.coalesce(F.when(age.isNotNull(), F.exp(-F.greatest(age, F.lit(0)) / 43.3)), F.lit(missing))


def freshness_step(date: Column, as_of: Column) -> Column:
    """The quality score's step function of age; 0 without a date, 0.3 for one that can't be read."""
    age = age_days(date, as_of)
    steps = F.when(age < 0, 0.7).when(age <= 7, 1.0).when(age <= 30, 0.9).when(age <= 365, 0.7).when(age <= 1095, 0.5)
    return F.when(F.coalesce(date, F.lit("")) == "", 0.0).otherwise(F.coalesce(steps, F.lit(0.3)))


def freshness_bucket(age: Column) -> Column:
    return F.when(age <= 1, "< 1 day").when(age <= 7, "1–7 days").when(age <= 28, "1–4 weeks").when(age <= 90, "1–3 months").when(age <= 365, "3–12 months").otherwise("> 1 year")


def grade(score: Column) -> Column:
    return F.when(score >= 0.80, "A").when(score >= 0.65, "B").when(score >= 0.50, "C").when(score >= 0.35, "D").otherwise("F")


def domain_score(pages: Column, content: Column, quality: Column, block_rate: Column) -> Column:
    return 0.40 * quality + 0.30 * (content / F.greatest(pages, F.lit(1))) + 0.20 * F.least(F.log1p(pages) / F.log1p(F.lit(500.0)), F.lit(1.0)) + 0.10 * (1 - block_rate)


def combined_score(trust: Column, relevance: Column, quality: Column, freshness: Column) -> Column:
    return trust * 0.40 + relevance * 0.30 + quality * 0.20 + freshness * 0.10


def sentiment(text: Column, title: Column) -> Column:
    """(label, score) by distinct lexicon words of the title and the first 3,000 characters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.concat(title, F.lit(" "), F.substring(text, 1, 3000))), F.lit("[a-z]+"), 0))
    hits = lambda lexicon: F.size(F.array_intersect(words, F.array(*map(F.lit, lexicon))))
    bull, bear = hits(C.BULLISH), hits(C.BEARISH)
    score = F.when(bull + bear > 0, (bull - bear) / (bull + bear)).otherwise(F.lit(0.0))
    return F.struct(F.when(score > 0.1, "bullish").when(score < -0.1, "bearish").otherwise("neutral").alias("label"), score.alias("score"))


def signals(text: Column) -> Column:
    """Sorted distinct kinds of the patterns found in the first 5,000 characters, whatever the case of A-Z.

    Case is folded once; patterns that are plain alternatives are looked up as strings, only the others are regexes."""

    def found(head: Column) -> Column:
        hits = []
        for pattern, kind in C.SIGNALS:
            plain = re.fullmatch(r"\(([a-z |]+)\)", pattern)
            hits.append(F.when(any_of(head, plain[1].split("|")) if plain else head.rlike(pattern), kind))
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))

    return bound(F.translate(F.substring(text, 1, 5000), ascii_uppercase, ascii_lowercase), found)


def any_of(where: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, [where.contains(w) for w in words])


def looks_like_article_title(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return ~t.rlike(C.NAVIGATION_TITLE) & ((word_count(t) >= 5) | (F.length(t) >= 35))


def summary(text: Column, limit: int = 300) -> Column:
    """Sentences from the start as long as they fit; none if the first is too long already."""
    taken = F.aggregate(F.split(text, r"(?<=[.!?])\s+"), F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
                        lambda a, s: F.when(a.full | (F.length(a.s) + F.length(s) > limit), F.struct(a.s.alias("s"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a.s, s, F.lit(" ")).alias("s"), F.lit(False).alias("full"))))
    return F.trim(taken.s)


#: A few frequent words of each language for the vote.
LANGUAGE_WORDS = {"en": ["the", "and", "of", "in", "to", "that"], "de": ["der", "die", "und", "das", "ist", "den"], "fr": ["le", "la", "les", "et", "des", "une"], "es": ["el", "los", "las", "que", "y", "del"]}


def language(text: Column) -> Column:
    """The language of which most frequent words stand in the first 1,000 characters; 'en' for short texts and ties."""

    def vote(words: Column, k: int, lang: str) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(LANGUAGE_WORDS[lang]))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang"))

    words = F.split(F.lower(F.substring(text, 1, 1000)), r"[^\p{L}]+")
    most = bound(words, lambda w: F.array_max(F.array(*[vote(w, k, lang) for k, lang in enumerate(LANGUAGE_WORDS)])).lang)
    return F.when(F.length(F.trim(text)) < 30, "en").otherwise(most)


def duplicate_method(reason: Column, canonical: bool = False) -> Column:
    """Kind of a duplicate reason: the first word of a fixed order that it contains.  canonical: with a bucket of its own."""
    rules = [("simhash", "SimHash near-duplicate"), ("title", "Title similarity"), *([("canonical", "Canonical URL"), ("normalized", "URL normalization")] if canonical else [("canonical", "URL normalization"), ("normalized", "URL normalization")]),
             ("amp", "AMP variant"), ("print", "Print variant"), ("mobile", "Mobile variant"), ("hash", "Exact content hash")]
    out = F.when(reason.contains(rules[0][0]), rules[0][1])
    for word, name in rules[1:]:
        out = out.when(reason.contains(word), name)
    return out.otherwise(F.when(reason == "", "URL normalization").otherwise(F.substring(reason, 1, 30)))


def unwrapped_metadata(blob: Column) -> Column:
    """The JSON object of a metadata column, also where it was serialised twice."""
    return F.coalesce(F.get_json_object(blob, "$.metadata_json"), blob)


def js_framework(html: Column) -> Column:
    low, out = F.lower(html), None
    for name, markers in C.JS_MARKERS:
        hit = F.lit(False)
        for m in markers:
            hit = hit | low.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def needs_browser(html: Column, words: Column) -> Column:
    """Whether a page has to be rendered before anything can be read from it."""
    low = F.lower(html)
    count = lambda s: (F.length(low) - F.length(F.replace(low, F.lit(s), F.lit("")))) / len(s)
    return ((js_framework(html) != "") & (words < 50)) | ((count("<script") / F.greatest(count("<"), F.lit(1.0)) > 0.3) & (words < 100)) | (low.contains("<noscript>") & (words < 50))


def block_status(status: Column, html: Column, server: Column) -> Column:
    """(blocked, reason, should_retry) of a response."""
    no, yes = F.lit(False), F.lit(True)
    made = lambda reason, retry: F.struct(yes.alias("blocked"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), retry.alias("should_retry"))
    head, size = F.lower(F.substring(html, 1, 8000)), F.length(F.trim(html))
    title, h1 = F.regexp_extract(head, r"(?s)<title[^>]*>(.*?)</title>", 1), F.regexp_extract(head, r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    captcha = (size < 4000) & (title.contains("captcha") | h1.rlike("captcha|are you human|verify"))
    return (F.when(status == 403, made("http_403_forbidden", no)).when(status == 429, made("rate_limited_429", yes)).when((status == 503) & F.lower(F.coalesce(server, F.lit(""))).contains("cloudflare"), made("cloudflare_503", no))
            .when(status == 503, made("service_unavailable_503", yes)).when(status == 401, made("requires_auth_401", no)).when(status >= 400, made(F.concat(F.lit("http_error_"), status.cast("string")), no))
            .when(head.rlike("cf-browser-verification|checking your browser|<title>just a moment"), made("cloudflare_challenge", no)).when(captcha, made("captcha_detected", no))
            .when(head.contains("enable javascript and cookies to continue"), made("anti_bot_detected", no)).when((size < 200) & (status == 200), made("suspiciously_empty_response", yes))
            .otherwise(F.struct(no.alias("blocked"), F.lit("").alias("reason"), no.alias("should_retry"))))


def expand_query(query: str) -> dict:
    """A research query's ticker and company.  A query is one short string on the driver: plain Python."""
    clean, low = query.strip(), query.strip().lower()
    name = next((n for n in C.TICKERS if n in low), None)
    ticker, company = (C.TICKERS[name], name.title()) if name else (None, clean)
    if re.fullmatch(r"[A-Z]{1,5}", clean):
        ticker, company = clean, {t: n for n, t in C.TICKERS.items() if t}.get(clean, clean)
    return {"query": clean, "query_lower": low, "company_name": company, "ticker": ticker}


def query_terms(params: dict) -> list[str]:
    """Terms that a relevant article should hold."""
    words = {*re.findall(r"[a-z]{3,}", params["query_lower"]), *([params["ticker"].lower()] if params["ticker"] else []), *params["company_name"].lower().split()}
    return sorted(words - {"the", "a", "an", "and", "or", "of", "in", "is", "for", "to", "it", "at", "by"})


def relevance(text: Column, title: Column, terms: list[str]) -> Column:
    """Part of the terms in the title and the first 2,000 characters, with a bonus for the title."""
    if not terms:
        return F.when((text == "") & (title == ""), 0.0).otherwise(0.5)
    low_title = F.lower(title)
    both = F.concat(low_title, F.lit(" "), F.lower(F.substring(text, 1, 2000)))
    found = lambda where: sum((where.contains(t).cast("int") for t in terms), F.lit(0)) / len(terms)
    return F.when((text == "") & (title == ""), 0.0).otherwise(F.least(0.7 * found(both) + 0.3 * found(low_title), F.lit(1.0)))


def expanded_queries(query: str) -> list[str]:
    """The query, its known expansions and a news variant; three at most."""
    low, out = query.lower(), [query]
    for term, more in C.QUERY_EXPANSIONS.items():
        if term in low:
            out += [m for m in more if m not in low]
            break
    return (out if any(w in low for w in ("news", "latest", "update")) else [*out, f"{query} news 2026"])[:3]

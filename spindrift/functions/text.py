"""Text columns: tokens, sentences, packing, ids, cut-offs, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits text for token counts: letters, up to three digits, or other signs.
TOKEN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


def token_count(text: Column) -> Column:
    """Pre-tokens of a text: a lower bound of subword tokens; 0 for an empty or null one."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts after ``.``, ``!`` or ``?`` and white space."""
    return F.split(text, r"(?<=[.!?])\s+")


def pack(parts: Column, most: int, joint: str = " ") -> Column:
    """Packs parts greedily in order to texts of at most ``most`` tokens, counting each part alone: an array of
    (text, tokens).  A longer part stays whole."""
    start = F.struct(F.array().cast("array<struct<text:string,tokens:int>>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("tokens"))

    # a function's column is computed at each place where it stands, so tokens are counted first, once a part
    counted = F.transform(parts, lambda p: F.struct(p.alias("part"), token_count(p).alias("n")))

    def step(held: Column, one: Column) -> Column:
        part, n = one["part"], one["n"]
        full = (held["text"] != "") & (held["tokens"] + n > most)
        done = F.when(full, F.concat(held["done"], F.array(F.struct(held["text"].alias("text"), held["tokens"].alias("tokens"))))).otherwise(held["done"])
        text = F.when(full | (held["text"] == ""), part).otherwise(F.concat(held["text"], F.lit(joint), part))
        return F.struct(done.alias("done"), text.alias("text"), F.when(full, n).otherwise(held["tokens"] + n).alias("tokens"))

    def finish(held: Column) -> Column:
        last = F.array(F.struct(held["text"].alias("text"), held["tokens"].alias("tokens")))
        return F.when(held["text"] != "", F.concat(held["done"], last)).otherwise(held["done"])

    return F.aggregate(counted, start, step, finish)


#: White space as Python's ``str.strip`` and ``\s`` have it, for a character class.
_WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def slug(text: Column) -> Column:
    r"""Lower case, without signs, joined by hyphens; with Python's white space and ``\w`` (letters, numbers, ``_``; no
    combining marks), for texts of any script."""
    own = F.regexp_replace(F.lower(text), rf"\A[{_WHITE}]+|[{_WHITE}]+\z", "")
    return F.regexp_replace(F.regexp_replace(own, rf"[^\p{{L}}\p{{N}}_{_WHITE}-]", ""), rf"[{_WHITE}_]+", "-")


# Fixed value: what counts as a version number.
_VERSION = r"v?(\d+\.\d+(?:\.\d+)?(?:\.x)?)"


def version(headings: Column, content: Column) -> Column:
    """The first version number in the headings, else in the first 200 characters of the content; else null."""
    found = F.filter(F.transform(headings, lambda h: F.regexp_extract(h, _VERSION, 1)), lambda v: v != "")
    body = F.regexp_extract(F.substring(content, 1, 200), _VERSION, 1)
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.when(body != "", body))


def code_identifiers(code: Column, most: int = 20) -> Column:
    """Names called, long options and constants, distinct, in code point order, the first ``most`` joined by a blank."""
    calls = F.regexp_extract_all(code, F.lit(rf"(?i)\b([a-z_][a-z0-9_]*)[{_WHITE}]*\("), F.lit(1))
    options = F.regexp_extract_all(code, F.lit(r"--([a-z][a-z0-9-]+)"), F.lit(1))
    constants = F.regexp_extract_all(code, F.lit(r"\b([A-Z][A-Z0-9_]{2,})\b"), F.lit(1))
    return F.array_join(F.slice(F.sort_array(F.array_distinct(F.concat(calls, options, constants))), 1, most), " ")


def heading_path(headings: Column) -> Column:
    return F.array_join(headings, " > ")


def chunk_id(url: Column, headings: Column, part: Column) -> Column:
    """16 hexadecimal digits from URL, heading path and number of the part."""
    path = F.when(F.size(headings) > 0, heading_path(headings)).otherwise("root")
    return F.substring(F.sha2(F.concat(url, F.lit("||"), path, F.lit("::"), part.cast("string")), 256), 1, 16)


def child_id(parent: Column, n: Column) -> Column:
    return F.concat(parent, F.lit("_child_"), n.cast("string"))


def content_hash(text: Column, digits: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def code_fence(language: Column, code: Column) -> Column:
    return F.concat(F.lit("```"), F.coalesce(F.regexp_replace(language, "^language-", ""), F.lit("")), F.lit("\n"), code, F.lit("\n```"))


def shortened(text: Column, most: int, end: str = "...") -> Column:
    """The first ``most`` characters and ``end``, if longer; the whole text where ``most`` is 0."""
    return text if most <= 0 else F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(end))).otherwise(text)


def logged_response(text: Column, most: int) -> Column:
    whole = F.concat(F.substring(text, 1, most), F.lit("\n... (truncated, total: "), F.length(text).cast("string"), F.lit(" chars)"))
    return F.when(F.length(text) > most, whole).otherwise(text)


def valid_context(context: Column) -> Column:
    """Trimmed; null under 10 characters, cut at 1,000."""
    own = F.trim(context)
    return F.when(F.length(own) >= 10, shortened(own, 1000))


def with_context(context: Column, content: Column) -> Column:
    """A chunk's text behind its context, where it has one."""
    return F.when(context.isNotNull(), F.concat(F.lit("<context>\n"), context, F.lit("\n</context>\n\n"), content)).otherwise(content)


def context_key(chunk: Column, original: Column) -> Column:
    """Cache key of a chunk's context, from its text without any context."""
    return F.concat(chunk, F.lit(":"), content_hash(original, 16))


def as_json(*columns: Column) -> Column:
    """A result row as JSON: timestamps in ISO form, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})


def prompt(template: str, document: Column, chunk: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{document}"), document), F.lit("{chunk}"), chunk)


def spoken_time(ts: Column) -> Column:
    return F.regexp_replace(F.date_format(ts, "EEEE, MMMM dd, yyyy 'at' hh:mm a z"), r"at 0", "at ")


# HTTP statuses and what they mean.
STATUS_NAMES = {-1: "Blocked (robots.txt)", 0: "Network Error", 200: "OK", 201: "Created", 301: "Moved Permanently", 302: "Found (Redirect)", 304: "Not Modified", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 408: "Request Timeout", 429: "Too Many Requests", 500: "Internal Server Error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}
STATUS_RANGES = ((200, "Success"), (300, "Redirect"), (400, "Client Error"), (500, "Server Error"))


def status_name(status: Column) -> Column:
    out = None
    for code, name in STATUS_NAMES.items():
        out = F.when(status == code, name) if out is None else out.when(status == code, name)
    for low, name in STATUS_RANGES:
        out = out.when(status.between(low, low + 99), name)
    return out.otherwise("Unknown")


def status_code_text(status: Column) -> Column:
    return F.when(status == -1, "N/A").when(status == 0, "ERR").otherwise(status.cast("string"))

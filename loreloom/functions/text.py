"""Text normal forms and text predicates as Column expressions.

All of them run inside the JVM. ``fold`` is the single definition of case
folding; every key below is built on it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, patterns and word lists that define the
# results. They are parameters of the data format and must not drift.
ALIAS_DROP = "[^0-9a-z\u3400-\u9fff]+"
MEMORY_DROP = "[^0-9a-z\u4e00-\u9fff]+"
SIMHASH_TOKEN = "[0-9a-z]+|[\u3400-\u9fff]"
QUERY_TOKEN = "[0-9a-z]+|[\u3400-\u9fff]{2,}"
QUERY_STRIP = "[\"'():*^]"
REDIRECT_PATTERN = r"(?iu)^\s*#(?:重定向|redirect)\s*:?[\s\u200e\u200f]*\[\[([^\]|#]+)"
EXACT_ID_PATTERN = r"^(?:[0-9]+|[a-z][a-z0-9_-]*:[a-z0-9][a-z0-9._/-]*)$"
OUT_OF_SCOPE_PATTERNS = (
    r"\bfiend\s+folio\b|\bmodded\b",
    "(?:第三方|某个|这个)?模组(?:道具|角色|敌人|内容)",
)
GENERIC_ALIASES = (
    "道具", "物品", "角色", "人物", "房间", "章节", "路线", "机制", "模组",
    "item", "room", "character", "route", "mod", "isaac", "wiki",
)
UNSAFE_MARKERS = (
    "api key", "apikey", "authorization:", "bearer ", "workspace_id",
    "workspace id", "访问令牌", "授权头", "密钥", "密码", "token=",
    "prompt injection", "忽略之前的指令", "system prompt",
    "```", "<script", "select * from", "-----begin private key-----",
)
PLAIN_TRIM = " \n|;："
# End of fixed values.

LINE_BREAKS = "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def fold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


_SPACES = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(c, F.lit(_SPACES))


def squeeze(c: Column) -> Column:
    """Collapse white space runs to one space and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def alias_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), ALIAS_DROP, "")


def dedupe_key(c: Column) -> Column:
    return alias_key(c)


def memory_key(c: Column) -> Column:
    return F.regexp_replace(fold(c), MEMORY_DROP, "")


def title_key(c: Column) -> Column:
    text = F.regexp_replace(strip(c), "[ _]+", " ")
    colon = F.instr(text, ":")
    namespace = F.substring(text, F.lit(1), colon)
    title = F.substring(text, colon + 1, F.length(text))
    return F.concat(
        F.when(colon > 0, namespace).otherwise(F.lit("")),
        F.upper(F.substring(title, 1, 1)),
        F.substring(title, F.lit(2), F.length(title)),
    )


def redirect_target(c: Column) -> Column:
    found = strip(F.regexp_extract(c, REDIRECT_PATTERN, 1))
    return F.when(found != "", found)


def norm_plain(c: Column) -> Column:
    text = F.regexp_replace(c, "[\u200e\u200f]", "")
    text = F.regexp_replace(text, "[ \t\u000c\u000b]+", " ")
    text = F.regexp_replace(text, r"(?U)\s*\n\s*", "\n")
    return F.btrim(text, F.lit(PLAIN_TRIM))


def norm_block(c: Column) -> Column:
    """Strip list markers per line, squeeze, and keep single blank separators."""
    lines = F.split(F.regexp_replace(c, LINE_BREAKS, "\n"), "\n")
    cleaned = F.transform(
        lines, lambda x: squeeze(F.regexp_replace(x, r"(?U)^\s*[#*:;]+\s*", ""))
    )
    joined = F.regexp_replace(F.array_join(cleaned, "\n"), "\n{3,}", "\n\n")
    return strip(joined)


def _accent_table() -> tuple[str, str]:
    """Latin letters whose canonical decomposition starts with an ASCII letter."""
    source, target = [], []
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(point))[0]
        if base != chr(point) and base.isascii():
            source.append(chr(point))
            target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def search_text(c: Column) -> Column:
    """Full-text normal form: lower case, accents removed, tokens split by one space.

    A run of letters or digits is one token, so a run of CJK characters is one
    token as well. The text is padded with a space on both sides, which makes a
    phrase test a plain substring test.
    """
    bare = F.regexp_replace(F.lower(c), "[\u0300-\u036f]", "")
    bare = F.translate(bare, _ACCENTED, _PLAIN)
    words = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}\p{Co}]+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))).otherwise(F.lit(""))


def search_tokens(normal: Column) -> Column:
    """Tokens of an already normalised ``search_text`` column."""
    return F.when(
        normal != "", F.split(F.trim(normal), " ")
    ).otherwise(F.array().cast("array<string>"))


def query_terms(c: Column, limit: int | None = 8) -> Column:
    """The cleaned query first, then its Latin/number and CJK runs, distinct; ``limit`` None keeps all."""
    cleaned = strip(F.regexp_replace(fold(c), QUERY_STRIP, " "))
    runs = F.regexp_extract_all(cleaned, F.lit(QUERY_TOKEN), F.lit(0))
    terms = F.filter(F.concat(F.array(cleaned), runs), lambda x: x != "")
    distinct = F.array_distinct(terms)
    return distinct if limit is None else F.slice(distinct, 1, limit)


def is_exact_id(c: Column) -> Column:
    return fold(strip(c)).rlike(EXACT_ID_PATTERN)


def is_out_of_scope(c: Column, patterns: Sequence[str] = OUT_OF_SCOPE_PATTERNS) -> Column:
    folded = fold(c)
    verdict = F.lit(False)
    for pattern in patterns:
        verdict = verdict | folded.rlike("(?U)" + pattern)
    return verdict


def looks_unsafe(c: Column, markers: Sequence[str] = UNSAFE_MARKERS) -> Column:
    folded = fold(c)
    verdict = F.contains(c, F.lit("\u0000"))
    for marker in markers:
        verdict = verdict | F.contains(folded, F.lit(marker))
    return F.coalesce(verdict, F.lit(False))


def contained_keys(c: Column) -> Column:
    """Alias keys that may occur inside a query: the bounded form of a substring join.

    Single words, two to four words run together, and CJK substrings of 2 to 12
    characters. Overlapping runs come from a look-ahead, so the text is folded
    and scanned once per length.
    """
    words = F.regexp_extract_all(fold(c), F.lit("[0-9a-z]+"), F.lit(0))
    single = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))
    line = F.array_join(words, " ")
    grams = []
    for n in (2, 3, 4):
        run = " ".join(["[0-9a-z]+"] * n)
        pattern = f"(?<![0-9a-z])(?=({run})(?![0-9a-z]))"
        found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
        grams.append(F.transform(found, lambda g: F.replace(g, F.lit(" "), F.lit(""))))
    runs = F.regexp_extract_all(c, F.lit("[\u3400-\u9fff]+"), F.lit(0))

    def cuts(run: Column) -> Column:
        longest = F.least(F.length(run), F.lit(12))
        sizes = F.when(longest >= 2, F.sequence(F.lit(2), longest)).otherwise(
            F.array().cast("array<int>")
        )
        return F.flatten(
            F.transform(
                sizes,
                lambda n: F.transform(
                    F.sequence(F.lit(1), F.length(run) - n + 1),
                    lambda s: F.substring(run, s, n),
                ),
            )
        )

    cjk = F.flatten(F.transform(runs, cuts))
    keys = F.array_distinct(F.concat(single, *grams, cjk))
    return F.filter(keys, lambda k: F.length(k) >= 2)


def bigrams(key: Column) -> Column:
    """Distinct character pairs of a key; a one-character key is its own pair."""
    pairs = F.array_distinct(F.regexp_extract_all(key, F.lit("(?s)(?=(..))"), F.lit(1)))
    return F.when(F.length(key) >= 2, pairs).when(key != "", F.array(key)).otherwise(
        F.array().cast("array<string>")
    )


def first_per_key(items: Column, type_: str, key: str = "key") -> Column:
    """First struct of every key in an array of structs, order kept."""

    def keep(acc: Column, s: Column) -> Column:
        known = F.exists(acc, lambda a: a[key] == s[key])
        return F.when(known, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(items, F.array().cast(f"array<{type_}>"), keep)


def unique_aliases(values: Column) -> Column:
    """One alias per normal form: the shortest, then the folded order, then the first."""
    keyed = F.transform(
        F.transform(values, norm_plain),
        lambda v, i: F.struct(
            alias_key(v).alias("key"),
            F.length(v).alias("size"),
            fold(v).alias("folded"),
            i.alias("seen"),
            v.alias("value"),
        ),
    )
    fit = F.array_sort(F.filter(keyed, lambda s: (s["key"] != "") & (s["size"] <= 120)))
    kept = first_per_key(fit, "struct<key:string,size:int,folded:string,seen:int,value:string>")
    ordered = F.array_sort(
        F.transform(kept, lambda s: F.struct(s["folded"].alias("f"), s["value"].alias("v")))
    )
    return F.transform(ordered, lambda s: s["v"])


def best_name(aliases: Column, cjk: bool) -> Column:
    """Shortest alias of the wanted script that is not an id code."""
    has_cjk = lambda v: v.rlike("[\u3400-\u9fff]")
    fit = F.filter(
        aliases,
        lambda v: ~strip(v).rlike(r"^[CcTtKk]\d+$")
        & (has_cjk(v) if cjk else ~has_cjk(v))
        & (F.length(v) > 1)
        & (F.length(v) <= 80),
    )
    ranked = F.transform(
        fit,
        lambda v, i: F.struct(
            F.length(v).alias("n"), fold(v).alias("f"), i.alias("i"), v.alias("v")
        ),
    )
    return F.array_min(ranked)["v"]


def topic_key(topic: Column, content: Column) -> Column:
    given = F.substring(memory_key(topic), 1, 120)
    digest = F.substring(F.sha2(memory_key(content), 256), 1, 24)
    return F.when(given != "", given).otherwise(F.concat(F.lit("content:"), digest))


def clean_scalar(c: Column) -> Column:
    """Scalar of a data row as text; missing becomes the empty string."""
    return F.coalesce(norm_plain(c.cast("string")), F.lit(""))


def date_prefix(c: Column) -> Column:
    return F.substring(c, 1, 10)

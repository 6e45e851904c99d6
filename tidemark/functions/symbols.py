"""Security-code, name and flag expressions (X9, N4, N13, N22, N23, TX1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes and board names of the market being modelled.
STAR_PREFIXES = ("688", "689")
STAR_PREFIXES_NARROW = ("688",)
CHINEXT_PREFIXES = ("300", "301")
BOARD_STAR, BOARD_SSE = "科创板", "上证主板"
BOARD_CHINEXT, BOARD_SZSE, BOARD_BSE = "创业板", "深证主板", "北交所"
ETF_20PCT = ("159915", "588000")


def _starts_with_any(value: Column, prefixes: tuple[str, ...]) -> Column:
    return value.rlike("^(" + "|".join(prefixes) + ")")


def pad_symbol(value: Column) -> Column:
    """Left-pad to six characters; longer codes are kept whole."""
    text = value.cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)


def extract_symbol(value: Column, *, at_end: bool = False) -> Column:
    """First (or trailing) six-digit run, NULL when there is none."""
    pattern = r"([0-9]{6})$" if at_end else r"([0-9]{6})"
    return F.nullif(F.regexp_extract(value.cast("string"), pattern, 1), F.lit(""))


def contains_st(name: Column) -> Column:
    return F.coalesce(F.contains(F.upper(name), F.lit("ST")), F.lit(False))


def infer_exchange(symbol: Column) -> Column:
    head = F.substring(symbol, 1, 1)
    return (
        F.when(head == "6", "SSE")
        .when(head.isin("0", "3"), "SZSE")
        .when(head.isin("4", "8", "9"), "BSE")
    )


def infer_board(
    symbol: Column, exchange: Column, star_prefixes: tuple[str, ...] = STAR_PREFIXES
) -> Column:
    sse = F.when(_starts_with_any(symbol, star_prefixes), BOARD_STAR).otherwise(BOARD_SSE)
    szse = F.when(_starts_with_any(symbol, CHINEXT_PREFIXES), BOARD_CHINEXT).otherwise(BOARD_SZSE)
    return F.when(exchange == "SSE", sse).when(exchange == "SZSE", szse).otherwise(BOARD_BSE)


def market_code(symbol: Column, style: str = "plain", exchange: Column | None = None) -> Column:
    """Prefix a code with its market; NULL marks a code the style does not cover.

    ``plain``  sh600000 / sz000001 (funds included), ``dotted`` sh.600000 by code,
    ``exchange`` sh.600000 by the exchange column, ``index`` for benchmark codes.
    """
    code = pad_symbol(symbol)
    head = F.substring(code, 1, 1)
    if style == "plain":
        return F.when(head.isin("5", "6"), F.concat(F.lit("sh"), code)).when(
            head.isin("0", "1", "2", "3"), F.concat(F.lit("sz"), code)
        )
    if style == "dotted":
        return F.when(head == "6", F.concat(F.lit("sh."), code)).when(
            head.isin("0", "3"), F.concat(F.lit("sz."), code)
        )
    if style == "exchange":
        if exchange is None:
            raise ValueError("style 'exchange' needs the exchange column")
        return F.when(exchange == "SSE", F.concat(F.lit("sh."), code)).when(
            exchange == "SZSE", F.concat(F.lit("sz."), code)
        )
    if style == "index":
        raw = F.lower(F.trim(symbol.cast("string")))
        digits = pad_symbol(raw)
        prefix = (
            F.when(digits.startswith("399"), "sz").when(digits.startswith("899"), "bj").otherwise("sh")
        )
        return F.when(raw.rlike("^(sh|sz|bj|csi)"), raw).otherwise(F.concat(prefix, digits))
    raise ValueError(f"unknown market code style: {style}")


def is_a_share_code(dotted_code: Column) -> Column:
    """Keep A shares of the two main exchanges, drop indexes and B shares."""
    return F.coalesce(
        dotted_code.rlike(r"^sh\.6[0-9]{5}$") | dotted_code.rlike(r"^sz\.(00[0-3]|30[01])[0-9]{3}$"),
        F.lit(False),
    )


def parse_flag(value: Column, *, lenient: bool = False) -> Column:
    """Text/boolean to BOOLEAN. Unknown text is NULL (a violation) or False when lenient."""
    text = F.lower(F.trim(value.cast("string")))
    flag = F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
    return F.coalesce(flag, F.lit(False)) if lenient else flag


def cohort_action(cohort: Column) -> Column:
    return (
        F.when(cohort.endswith("_apply"), "apply_st")
        .when(cohort.endswith("_remove"), "remove_st")
        .otherwise("unknown")
    )


def hash_shard(symbol: Column, shard_count: int) -> Column:
    """Stable bucket id: first 16 hex digits of sha256(symbol) modulo the shard count."""
    if shard_count <= 0:
        raise ValueError("shard_count must be positive")
    head = F.substring(F.sha2(pad_symbol(symbol), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % F.lit(shard_count)).cast("int")


def etf_board(symbol: Column) -> Column:
    return F.when(symbol.isin(*ETF_20PCT), "ETF20").otherwise("ETF10")


def first_column(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """Resolve a header by alias priority (plan time, header row only)."""
    by_trimmed = {name.strip(): name for name in columns}
    return next((by_trimmed[a] for a in aliases if a in by_trimmed), None)


def column_containing(columns: list[str], needles: tuple[str, ...]) -> str | None:
    return next((c for c in columns if all(n in c for n in needles)), None)


def need_column(columns: list[str], aliases: tuple[str, ...]) -> str:
    found = first_column(columns, aliases)
    if found is None:
        raise ValueError(f"none of {aliases} among columns {columns}")
    return found

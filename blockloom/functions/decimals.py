"""Exact decimal text arithmetic wider than Spark's 38 digits, in built-in expressions only.

An amount is stored as decimal text.  For sums it is split into base-10^18 limbs (one for the
fraction, three for the integer part), each limb is summed as DECIMAL, and carries are settled
once per group.  Nothing here ever goes through DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB_DIGITS = 18
INTEGER_LIMBS = 3
SCALE = 18
AMOUNT_PATTERN = "^[+-]?[0-9]{1,54}([.][0-9]{1,18})?$"
CANONICAL_PATTERN = r"^[0-9]+([.][0-9]{1,18})?$"
SHORT_PATTERN = "^[+-]?[0-9]{1,6}([.][0-9]{1,18})?$"
_SHORT = "decimal(28,18)"  # sums to DECIMAL(38,18): 10^14 addends below 10^6
_LIMB = "decimal(22,0)"   # sums to DECIMAL(32,0): 10^14 addends of a full limb
_WIDE = "decimal(38,0)"
_BASE = "cast(1000000000000000000 as decimal(19,0))"


def limb_names(prefix: str) -> list[str]:
    return [f"{prefix}_{i}" for i in range(INTEGER_LIMBS + 1)]


def with_limbs(df: DataFrame, amount: str, prefix: str, sign: str = "1") -> DataFrame:
    """Split a decimal-text column for summing.  Text that does not parse raises.

    Everyday amounts (at most 6 whole digits) go into one DECIMAL column; only longer ones are
    cut into signed limbs, lowest first, so the limb columns are mostly NULL.
    """
    text, body, short = f"{prefix}_text", f"{prefix}_body", f"{prefix}_short"
    plain = f"case when `{amount}` rlike '{SHORT_PATTERN}' then cast(`{amount}` as {_SHORT}) end"
    checked = (f"case when {short} is not null or `{amount}` is null then null when trim(`{amount}`) rlike '{AMOUNT_PATTERN}' "
               f"then trim(`{amount}`) else raise_error(concat('not a decimal amount: ', `{amount}`)) end")
    width = LIMB_DIGITS * INTEGER_LIMBS
    staged = df.withColumns({short: F.expr(plain)}).withColumns({text: F.expr(checked)}).withColumns({
        body: F.expr(f"ltrim('+-', {text})"), short: F.expr(f"case when ({sign}) < 0 then -{short} else {short} end")})
    signed = f"(case when startswith({text}, '-') then -1 else 1 end * ({sign}))"
    pieces = [f"rpad(case when contains({body}, '.') then substring_index({body}, '.', -1) else '' end, {LIMB_DIGITS}, '0')"]
    pieces += [f"substring(lpad(substring_index({body}, '.', 1), {width}, '0'), {width - LIMB_DIGITS * (k + 1) + 1}, {LIMB_DIGITS})"
               for k in range(INTEGER_LIMBS)]
    limbs = {n: F.expr(f"case when {text} is not null then cast(cast({p} as bigint) * {signed} as {_LIMB}) end")
             for n, p in zip(limb_names(prefix), pieces)}
    return staged.withColumns(limbs).drop(text, body)


def limb_sums(prefix: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in (f"{prefix}_short", *limb_names(prefix))]


def _floor_div(value: str) -> str:
    """Exact floor division by the base (decimal division would round)."""
    return f"cast(({value} - pmod({value}, {_BASE})) div {_BASE} as {_WIDE})"


def _carry_out(values: list[str]) -> str:
    """What the limbs below the highest carry into it."""
    return f"aggregate(array({', '.join(values[:-1])}), cast(0 as {_WIDE}), (c, x) -> {_floor_div('(x + c)')})"


def _carried(df: DataFrame, prefix: str, values: list[str], plain: str = "false") -> DataFrame:
    """Replace the limbs by ones in [0, 10^18); only the highest may exceed that.  Where `plain` holds they already are."""
    names = limb_names(prefix)
    step = f"named_struct('c', {_floor_div('(x + a.c)')}, 'r', array_append(a.r, cast(pmod(x + a.c, {_BASE}) as {_WIDE})))"
    start = f"named_struct('c', cast(0 as {_WIDE}), 'r', cast(array() as array<{_WIDE}>))"
    lower = f"array({', '.join(values[:-1])})"
    packed = f"case when {plain} then named_struct('c', cast(0 as {_WIDE}), 'r', {lower}) else aggregate({lower}, {start}, (a, x) -> {step}) end"
    out = {n: F.expr(f"{prefix}_packed.r[{k}]") for k, n in enumerate(names[:-1])}
    out[names[-1]] = F.expr(f"cast({values[-1]} + {prefix}_packed.c as {_WIDE})")
    return df.withColumns({f"{prefix}_packed": F.expr(packed)}).withColumns(out).drop(f"{prefix}_packed")


def settle(df: DataFrame, prefix: str) -> DataFrame:
    """Turn summed limbs into `<prefix>_sign` and limbs in [0, 10^18); other columns stay."""
    short = f"cast({prefix}_short as string)"  # 18 fraction digits, so its limbs are cut from the text
    low = f"coalesce(cast(right({short}, {LIMB_DIGITS}) as {_LIMB}) * case when startswith({short}, '-') then -1 else 1 end, 0)"
    whole = f"coalesce(cast(substring_index({short}, '.', 1) as {_LIMB}), 0)"
    plain = [f"cast(coalesce({n}, 0) as {_WIDE})" for n in limb_names(prefix)]
    plain[0], plain[1] = f"cast({plain[0]} + {low} as {_WIDE})", f"cast({plain[1]} + {whole} as {_WIDE})"
    sign, only = f"{prefix}_sign", f"{prefix}_only"
    # a sum of short amounts below 10^18 has nothing to carry, and carrying is slow
    is_only = " and ".join([f"{n} is null" for n in limb_names(prefix)] + [f"coalesce(abs({prefix}_short) < {_BASE}, true)"])
    marked = df.withColumns({only: F.expr(is_only)}).withColumns({sign: F.expr(
        f"case when {only} then case when {prefix}_short < 0 then -1 else 1 end when {plain[-1]} + {_carry_out(plain)} < 0 then -1 else 1 end")})
    return _carried(marked, prefix, [f"cast({v} * {sign} as {_WIDE})" for v in plain], only).drop(f"{prefix}_short", only)


def exceeds(left: str, times_left: int, right: str, times_right: int) -> Column:
    """Whether times_left * left > times_right * right, exactly, for settled non-negative limbs."""
    d = [f"cast(cast({a} as decimal(30,0)) * {times_left} - cast({b} as decimal(30,0)) * {times_right} as {_WIDE})"
         for a, b in zip(limb_names(left), limb_names(right))]
    step = f"named_struct('c', {_floor_div('(x + a.c)')}, 'rest', a.rest or pmod(x + a.c, {_BASE}) <> 0)"
    low = f"aggregate(array({', '.join(d[:-1])}), named_struct('c', cast(0 as {_WIDE}), 'rest', false), (a, x) -> {step})"
    return F.expr(f"{d[-1]} + ({low}).c > 0 or ({d[-1]} + ({low}).c = 0 and ({low}).rest)")


def sortable(amount: Column) -> Column:
    """Non-negative decimal text padded to one width, so that text order is the order of the numbers."""
    body = F.ltrim(F.trim(amount.cast("string")), F.lit("+-"))
    fraction = F.when(body.contains("."), F.substring_index(body, ".", -1)).otherwise("")
    return F.concat(F.lpad(F.substring_index(body, ".", 1), LIMB_DIGITS * INTEGER_LIMBS, "0"), F.lit("."), F.rpad(fraction, SCALE, "0"))


def is_nonzero(prefix: str) -> Column:
    return F.expr("(" + " or ".join(f"{n} <> 0" for n in limb_names(prefix)) + ")")


def fixed_text(prefix: str) -> Column:
    """Settled limbs as text with 18 fraction digits."""
    names = limb_names(prefix)
    digits = ", ".join([f"cast({names[-1]} as string)"] + [f"lpad(cast({n} as string), {LIMB_DIGITS}, '0')" for n in reversed(names[1:-1])])
    nonzero = " or ".join(f"{n} <> 0" for n in names)
    return F.expr(f"concat(case when {prefix}_sign < 0 and ({nonzero}) then '-' else '' end, "
                  f"coalesce(nullif(ltrim('0', concat({digits})), ''), '0'), '.', lpad(cast({names[0]} as string), {LIMB_DIGITS}, '0'))")


def minimal_text(prefix: str) -> Column:
    """Settled limbs as text without trailing fraction zeros; whole numbers without a dot."""
    return F.rtrim(F.rtrim(fixed_text(prefix), F.lit("0")), F.lit("."))


def exact_sum(df: DataFrame, keys: list[str], amount: str, out: str, sign: str = "1") -> DataFrame:
    """Exact sum of decimal text per key as minimal text, plus `<out>_nonzero`."""
    prefix = f"__{out}"
    grouped = with_limbs(df, amount, prefix, sign).groupBy(*keys).agg(*limb_sums(prefix))
    return settle(grouped, prefix).select(
        *keys, minimal_text(prefix).alias(out), is_nonzero(prefix).alias(f"{out}_nonzero"))


def round_settled(df: DataFrame, prefix: str, decimals: str) -> DataFrame:
    """Round settled limbs half away from zero to a per-row number of fraction digits (0 to 18)."""
    names = limb_names(prefix)
    units = ", ".join(f"{10 ** (SCALE - d)}L" for d in range(SCALE + 1))
    unit = f"cast(element_at(array({units}), cast({decimals} as int) + 1) as {_WIDE})"
    low = names[0]
    rounded = f"({low} - {low} % __unit + case when __unit > 1 and ({low} % __unit) * 2 >= __unit then __unit else 0 end)"
    values = [f"cast({rounded} as {_WIDE})", *names[1:]]
    return _carried(df.withColumns({"__unit": F.expr(unit)}), prefix, values).drop("__unit")


def canonical_amount(amount: Column) -> Column:
    """Non-negative text with exactly 18 fraction digits and no leading zeros; anything else raises."""
    text = F.trim(amount.cast("string"))
    integer = F.regexp_replace(F.substring_index(text, ".", 1), "^0+(?=[0-9])", "")
    fraction = F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise("")
    return (
        F.when(amount.isNull(), F.lit(None).cast("string"))
        .when(text.rlike(CANONICAL_PATTERN), F.concat(integer, F.lit("."), F.rpad(fraction, SCALE, "0")))
        .otherwise(F.raise_error(F.concat(F.lit("non-canonical amount: "), F.coalesce(text, F.lit("null")))))
    )

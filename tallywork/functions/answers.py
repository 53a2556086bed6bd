"""Answer texts as whole numbers of any length.

A number is a text of digits. Arithmetic works on its limbs of nine digits, so no numeric type
bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywork.functions.text import strip

# The answer given when nothing was found, and the modulus of an answer.
DEFAULT_ANSWER = 210
MODULUS = 1000

LIMB_DIGITS, LIMB = 9, 10**9
#: Factors of two are divided out so many at a time; a remainder and a limb stay within 64 bits.
TWOS = 20
# The least whole number beyond all doubles.
_BEYOND = str(2**1024)


def _limbs(digits: Column) -> Column:
    """Groups of nine digits as numbers, the highest first."""
    count = F.ceil(F.length(digits) / LIMB_DIGITS).cast("int")
    padded = F.lpad(digits, count * LIMB_DIGITS, "0")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(padded, i * LIMB_DIGITS + 1, F.lit(LIMB_DIGITS)).cast("bigint"))


def _divided(limbs: Column) -> Column:
    """Quotient (limbs) and remainder by 2 ** TWOS, leading zeros taken off."""
    power = 1 << TWOS

    def step(done: Column, limb: Column) -> Column:
        value = F.struct((done["rest"] * LIMB + limb).alias("v"))
        return F.struct(
            F.when((F.size(done["limbs"]) == 0) & (value["v"] < power), done["limbs"]).otherwise(F.array_append(done["limbs"], F.floor(value["v"] / F.lit(power)).cast("bigint"))).alias("limbs"),
            F.pmod(value["v"], F.lit(power)).alias("rest"),
        )

    start = F.struct(F.array().cast("array<bigint>").alias("limbs"), F.lit(0).cast("bigint").alias("rest"))
    return F.aggregate(limbs, start, step)


def _double_holds(digits: Column) -> Column:
    """Whether a double holds the number exactly: at most 53 bits are left without its factors of two."""

    def divide(state: Column, _: Column) -> Column:
        next_ = _divided(state["limbs"])
        return F.when(state["done"] | (next_["rest"] != 0), F.struct(state["limbs"].alias("limbs"), F.lit(True).alias("done"))).otherwise(
            F.struct(next_["limbs"].alias("limbs"), F.lit(False).alias("done"))
        )

    # A digit is under 3.33 bits.
    rounds = F.ceil(F.length(digits) * 3.33 / TWOS).cast("int")
    odd = F.aggregate(F.sequence(F.lit(1), rounds), F.struct(_limbs(digits).alias("limbs"), F.lit(False).alias("done")), divide)["limbs"]
    # What is left is no multiple of 2 ** TWOS: below 2 ** 73 it fits a decimal, beyond it a double cannot hold it.
    left = F.aggregate(F.when(F.size(odd) <= 3, odd), F.lit(0).cast("decimal(38,0)"), lambda total, limb: (total * LIMB + limb).cast("decimal(38,0)"))
    whole = (left % (1 << TWOS)).cast("bigint")
    exact = left < F.lit(2**53).cast("decimal(38,0)") * whole.bitwiseAND(-whole).cast("decimal(38,0)")
    size = F.length(digits)
    finite = (size < len(_BEYOND)) | (size == len(_BEYOND)) & (digits < _BEYOND)
    return F.when(size <= 15, True).otherwise(finite & F.coalesce(exact, F.lit(False)))


def answer_value(answer: Column | str) -> Column:
    """The answer as plain digits with a sign only if negative, or NULL if it is not a whole
    number that a double holds exactly.

    Surrounding space, a sign, leading zeros and single underscores between digits are
    fine, and so are numbers of any length. Non-ASCII digits count as invalid.
    """
    answer = F.col(answer) if isinstance(answer, str) else answer
    text = strip(answer)
    digits = F.regexp_replace(F.replace(text, F.lit("_"), F.lit("")), "^[+-]?0*(?=[0-9])", "")
    negative = F.startswith(text, F.lit("-"))

    def value(d: Column) -> Column:
        return F.when(_double_holds(d), F.when(negative & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d))

    # Bound to a name, so that the digits are taken out once.
    bound = F.transform(F.array(digits), value)
    # Most answers are short and plain already.
    return F.when(answer.rlike("^(0|[1-9][0-9]{0,14})$"), answer).when(text.rlike(r"^[+-]?[0-9](_?[0-9])*$"), F.element_at(bound, 1))


def numeric_order(value: Column | str) -> Column:
    """A text by which values of ``answer_value`` sort as numbers."""
    value = F.col(value) if isinstance(value, str) else value
    digits = F.replace(value, F.lit("-"), F.lit(""))
    size = F.length(digits)
    positive = F.concat(F.lit("1"), F.lpad(size.cast("string"), 4, "0"), digits)
    negative = F.concat(F.lit("0"), F.lpad((9999 - size).cast("string"), 4, "0"), F.translate(digits, "0123456789", "9876543210"))
    return F.when(F.startswith(value, F.lit("-")), negative).otherwise(positive)


def is_valid_answer(answer: Column | str) -> Column:
    return answer_value(answer).isNotNull()


def floor_mod(value: Column | str, modulus: int = MODULUS) -> Column:
    """Modulo of a value with a result that is never negative; ``modulus`` below 10^9."""
    value = F.col(value) if isinstance(value, str) else value
    text = value.cast("string")
    digits = F.replace(text, F.lit("-"), F.lit(""))
    rest = F.aggregate(_limbs(digits), F.lit(0).cast("bigint"), lambda r, limb: (r * LIMB + limb) % modulus)
    signed = F.when(F.startswith(text, F.lit("-")), -rest).otherwise(rest)
    return F.when(F.length(text) <= 18, F.pmod(text.cast("bigint"), F.lit(modulus).cast("bigint"))).otherwise(F.pmod(signed, F.lit(modulus).cast("bigint")))

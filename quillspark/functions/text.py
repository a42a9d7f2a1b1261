"""Text functions on columns, with Python's notions of white space and line ends."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.schemas import FIM_MIDDLE, FIM_PREFIX, FIM_SUFFIX, MASK

# White space and line ends, in a notation that Java's and RE2's patterns share.
WHITE = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"
STRIPPED = rf"^{WHITE}+|{WHITE}+\z"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIPPED, "")


def is_blank(c: Column) -> Column:
    return F.regexp_like(c, F.lit(rf"^{WHITE}*\z"))


def split_lines(c: Column) -> Column:
    """Lines without their ends; no empty line after a final line end, none for an empty text."""
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return F.transform(F.array(F.split(c, LINE_END, -1)), whole)[0]  # bound to a name, so that it splits once


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def fim_prompt(prefix: Column, suffix: Column) -> Column:
    return F.concat(F.lit(FIM_PREFIX), prefix, F.lit(FIM_SUFFIX), suffix, F.lit(FIM_MIDDLE))


def fim_text(prefix: Column, suffix: Column, middle: Column) -> Column:
    return F.concat(fim_prompt(prefix, suffix), middle)


def has_sentinel(c: Column) -> Column:
    return F.contains(c, F.lit(FIM_PREFIX)) | F.contains(c, F.lit(FIM_SUFFIX)) | F.contains(c, F.lit(FIM_MIDDLE))


def before_mask(c: Column, mask: str = MASK) -> Column:
    """What stands before the first mask; all of it where there is none."""
    at = F.instr(c, mask)
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c)


def after_mask(c: Column, mask: str = MASK) -> Column:
    """What stands after the first mask, later masks included; empty where there is none."""
    at = F.instr(c, mask)
    return F.when(at > 0, F.substr(c, at + F.lit(len(mask)))).otherwise(F.lit(""))


def replace_first(c: Column, new: Column, mask: str = MASK) -> Column:
    return F.when(F.instr(c, mask) > 0, F.concat(before_mask(c, mask), new, after_mask(c, mask))).otherwise(c)

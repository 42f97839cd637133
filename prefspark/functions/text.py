"""Text expressions: strip, prompt layout and header replacement."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The layout of a steering prompt and of its suppressing counterpart.
INSTRUCTION_HEADER = "### Instruction\n"
STEERING_HEADER = "### Steering Direction\n"
SUPPRESSING_HEADER = "### Suppressing Direction\n"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends. A character set, not a pattern: linear time."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE)) == ""


def strip_newlines(text: Column) -> Column:
    return F.btrim(text, F.lit("\n"))


def lstrip_newlines(text: Column) -> Column:
    return F.ltrim(text, F.lit("\n"))


def rstrip_newlines(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


def prompt_text(instruction: Column, direction: Column) -> Column:
    """The prompt of a training pair. Its parts are kept as they are, not stripped."""
    return F.concat(
        F.lit(INSTRUCTION_HEADER), instruction, F.lit("\n\n" + STEERING_HEADER), direction
    )


def steered_prompt_text(instruction: Column, direction: Column, reverse: Column) -> Column:
    """The prompt used at generation time: stripped parts; ``reverse`` asks for suppression."""
    header = F.when(reverse, SUPPRESSING_HEADER).otherwise(STEERING_HEADER)
    return F.concat(
        F.lit(INSTRUCTION_HEADER), strip(instruction), F.lit("\n\n"), header, strip(direction)
    )


def to_suppressing(text: Column) -> Column:
    """Replace every steering header, newline included, by the suppressing one."""
    return F.replace(text, F.lit(STEERING_HEADER), F.lit(SUPPRESSING_HEADER))

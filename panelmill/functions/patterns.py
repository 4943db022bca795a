"""What a regular expression cannot match without."""

import re
import sys
from re import _constants as ops
from re import _parser as parser

from pyspark.cloudpickle import register_pickle_by_value

# Sent with the job, so that executors need not have it installed.
register_pickle_by_value(sys.modules[__name__])


def _runs(parsed) -> list[str]:
    """Literal runs that every match of a parsed sequence holds, in order; "" marks a break between them."""
    out = [""]
    for op, arg in parsed:
        if op is ops.LITERAL:
            out[-1] += chr(arg)
        elif op is ops.SUBPATTERN and not arg[1] and not arg[2]:  # a group without flags of its own
            inner = _runs(arg[3])
            out[-1] += inner[0]
            out += inner[1:]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] > 0:
            inner = _runs(arg[2])
            out[-1] += inner[0]
            out += ["", *inner[1:-1], inner[-1] if len(inner) > 1 else "", ""]
        elif op not in (ops.AT,):  # places hold no characters; all else may hold any
            out.append("")
    return out


def factor(pattern: str) -> str:
    """The longest literal that is in every match of ``pattern``, "" if none is known: patterns with flags, with alternatives
    only, or that the parser of the standard library does not know."""
    try:
        parsed = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return ""
    if parsed.state.flags & (re.I | re.X) or "(?" in pattern.replace("(?:", "").replace("(?P<", ""):
        return ""
    return max(_runs(parsed), key=len)


def literal_start(pattern: str) -> str:
    """The literal of a pattern that is ``^`` and a literal, "" for all others."""
    try:
        parsed = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return ""
    if parsed.state.flags & ~re.U or not len(parsed) or "(?" in pattern:
        return ""
    (op, arg), *rest = parsed
    if op is not ops.AT or arg is not ops.AT_BEGINNING or any(o is not ops.LITERAL for o, _ in rest):
        return ""
    return "".join(chr(a) for _, a in rest)

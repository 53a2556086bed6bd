"""Static checks of one piece of Python code; it is parsed, never run."""

from __future__ import annotations

import ast
import builtins
import io
import re
import tokenize
from collections.abc import Collection, Iterator
from dataclasses import dataclass

BUILTINS = frozenset(dir(builtins))


class TooDeep(SyntaxError):
    """The code nests deeper than the parser follows."""


def parsed(code: str) -> ast.Module | SyntaxError:
    try:
        return ast.parse(code)
    except SyntaxError as error:
        return error
    except ValueError as error:
        return SyntaxError(str(error))
    except RecursionError as error:
        return TooDeep(str(error))
    except MemoryError as error:
        # The parser reports its own depth limit like this. If memory for a tree can be had, it
        # was that; if not, the task fails and is tried again.
        bytearray(100 * len(code) + (64 << 20))
        return TooDeep(str(error))


def name_events(tree: ast.AST) -> Iterator[tuple[int, str, bool]]:
    """(line, name, whether it is defined there or read there) of every name that counts.

    Scope and order are ignored. Lambda, keyword-only and star arguments, and the name of
    an ``except ... as`` clause, do not count as definitions.
    """
    for node in ast.walk(tree):
        match node:
            case ast.Name(id=name, ctx=ast.Store(), lineno=line):
                yield line, name, True
            case ast.Name(id=name, ctx=ast.Load(), lineno=line):
                yield line, name, False
            case ast.FunctionDef(name=name, args=arguments, lineno=line):
                yield line, name, True
                yield from ((line, a.arg, True) for a in arguments.args)
            case ast.ClassDef(name=name, lineno=line):
                yield line, name, True
            case ast.Import(names=names, lineno=line):
                yield from ((line, n.asname or n.name.partition(".")[0], True) for n in names)
            case ast.ImportFrom(names=names, lineno=line):
                yield from ((line, n.asname or n.name, True) for n in names)


def undefined_uses(tree: ast.AST, allowed: Collection[str]) -> dict[str, int]:
    """Names read but nowhere defined, with the first line that reads each."""
    defined: set[str] = set()
    read: dict[str, int] = {}
    for line, name, defines in name_events(tree):
        if defines:
            defined.add(name)
        else:
            read[name] = min(line, read.get(name, line))
    known = defined | BUILTINS
    return {name: line for name, line in sorted(read.items()) if name not in known and name not in allowed}


def finding(code: str, allowed: Collection[str] = ()) -> tuple[str, list[str]]:
    """'ok', 'syntax_error', 'too_deep', or 'undefined' with the names."""
    tree = parsed(code)
    if isinstance(tree, SyntaxError):
        return "too_deep" if isinstance(tree, TooDeep) else "syntax_error", []
    names = list(undefined_uses(tree, allowed))
    return "undefined" if names else "ok", names


# Errors raised where the text is cut into tokens or blocks, as the parser words them.
AT_ONCE = (
    "unterminated", "unindent does not match", "unexpected indent", "unexpected character after line continuation",
    "invalid decimal literal", "invalid character", "invalid non-printable character", "unmatched ",
    "closing parenthesis", "leading zeros", "inconsistent use of tabs",
)


def _still_fails_from(error: SyntaxError, default: int) -> int:
    """First line from which every cut of the code fails in the same way.

    The parser reports a generic error at the last token it has read, so all cuts behind
    that line fail alike. So do cuts behind a line that has no valid tokens, and an unclosed
    bracket or string stays unclosed in shorter cuts. Other messages may point before what
    caused them and promise nothing.
    """
    message = error.msg or ""
    sure = message == "invalid syntax" or message.startswith(AT_ONCE) or message.endswith("was never closed")
    return min(error.lineno, default) if sure and error.lineno else default


@dataclass
class Statement:
    """A statement or a block's head: its lines, and whether code may end behind it."""

    first: int
    last: int
    may_end: bool


_BLANK = re.compile(r"[ \t]*(#.*)?")
_CLAUSES = ("except", "finally")


def statements(code: str) -> list[Statement]:
    """The statements of ``code`` from one pass over its tokens, as far as these are valid.

    Code may not end behind the head of a block that has no line yet, behind a decorator, or
    while a ``try`` has no clause.
    """
    out: list[Statement] = []
    depth, open_tries = 0, []
    first = opening = last_mark = None
    try:
        for token in tokenize.generate_tokens(io.StringIO(code).readline):
            if token.type == tokenize.INDENT:
                depth += 1
            elif token.type == tokenize.DEDENT:
                depth -= 1
            elif token.type == tokenize.NEWLINE and first is not None:
                if opening == "try":
                    open_tries.append(depth)
                elif opening in _CLAUSES and open_tries and open_tries[-1] == depth:
                    open_tries.pop()
                out.append(Statement(first, token.start[0], last_mark != ":" and opening != "@" and not open_tries))
                first = None
            elif token.type not in (tokenize.NL, tokenize.COMMENT, tokenize.NEWLINE, tokenize.ENDMARKER):
                if first is None:
                    first, opening = token.start[0], token.string
                last_mark = token.string
    except (tokenize.TokenError, SyntaxError):
        pass
    return out


def longest_valid_prefix(code: str, allowed: Collection[str] = ()) -> tuple[str, str, list[str]]:
    """Longest run of whole lines that parses without undefined names, what follows it, and
    the names undefined in the next longer run that parses. The last line counts as incomplete.

    One pass over the tokens lists where statements end. If the run up to one end parses, so do
    the runs up to those before it, hence the last that parses is found by bisection; one walk
    over its tree then tells for every end which names are still undefined there.
    """
    if any(c in code for c in "\r\f\0\ufeff"):
        return _by_parsing(code, allowed)
    lines = code.split("\n")[:-1]

    def run(n: int) -> str:
        text = "\n".join(lines[:n])
        return text if text.endswith("\n") else text + "\n"

    def with_blank(n: int) -> int:
        """The line up to which only blank ones and comments follow line ``n``."""
        while n < len(lines) and _BLANK.fullmatch(lines[n]):
            n += 1
        return n

    every = statements(run(len(lines)))
    ends = [i for i, s in enumerate(every) if s.may_end]
    low, high, tree = 0, len(ends), ast.Module([], [])
    while low < high:
        middle = (low + high + 1) // 2
        found = parsed(run(every[ends[middle - 1]].last))
        if isinstance(found, SyntaxError):
            high = middle - 1
        else:
            low, tree = middle, found
    of_line = {line: i for i, s in enumerate(every) for line in range(s.first, s.last + 1)}
    events: dict[int, list[tuple[str, bool]]] = {}
    for line, name, defines in name_events(tree):
        events.setdefault(of_line[line], []).append((name, defines))
    defined, open_names = set(BUILTINS) | set(allowed), set()
    best, later, names = with_blank(0), False, []
    at = 0
    for end in ends[:low]:
        while at <= end:
            for name, defines in events.get(at, ()):
                if defines:
                    defined.add(name)
                    open_names.discard(name)
                elif name not in defined:
                    open_names.add(name)
            at += 1
        if not open_names:
            best, later, names = with_blank(every[end].last), False, []
        elif not later:
            later, names = True, sorted(open_names)
    return (run(best), "\n".join(lines[best:]), names) if best else ("", code, [])


def _by_parsing(code: str, allowed: Collection[str]) -> tuple[str, str, list[str]]:
    """``longest_valid_prefix`` by parsing run after run, for code with other line breaks.

    Runs that must fail are skipped: those that still hold a sure syntax error, and those
    that still read a name undefined in a longer run.
    """
    lines = code.split("\n")[:-1]
    may_skip = "\r" not in code

    def cut(n: int) -> str:
        text = "\n".join(lines[:n])
        return text if text.endswith("\n") else text + "\n"

    n, blamed = len(lines), False
    while n > 0:
        tree = parsed(cut(n))
        if isinstance(tree, SyntaxError):
            n = (_still_fails_from(tree, n) if may_skip else n) - 1
            continue
        uses = undefined_uses(tree, allowed)
        if not uses:
            break
        blamed = True
        n = (min(min(uses.values()), n) if may_skip else n) - 1
    if n <= 0:
        return "", code, []
    names: list[str] = []
    for longer in range(n + 1, len(lines) + 1) if blamed else ():
        tree = parsed(cut(longer))
        if not isinstance(tree, SyntaxError):
            names = list(undefined_uses(tree, allowed))
            break
    return cut(n), "\n".join(lines[n:]), names

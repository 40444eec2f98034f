"""Top-level import names of Python sources, parsed by a child process that is replaced after a bounded amount of text.

CPython keeps every name that it parses for the life of the process, so a worker that parses a whole tree would grow with
the number of different names in it.  Here the parser runs beside the worker: it gets some files at a time over its
standard input, and after ``PARSER_BYTES`` of text it ends and the next one starts.
"""

from __future__ import annotations

import ast
import pickle
import subprocess
import sys
from pathlib import Path

#: characters of source text that one parser reads before it is replaced (a longer file has a parser of its own)
PARSER_BYTES = 4 << 20


class _Imported(ast.NodeVisitor):
    """Gathers the first name part of every import; relative imports without a module have none."""

    def __init__(self):
        self.names: list[str] = []

    def visit_Import(self, node: ast.Import) -> None:
        self.names += [alias.name.partition(".")[0] for alias in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        if node.module:
            self.names.append(node.module.partition(".")[0])


def top_level_imports(source: str) -> tuple[list[str], str | None]:
    """Top-level names imported anywhere in ``source``, and the error of a file
    that the parser gives up on for whatever reason (syntax, null bytes, nesting
    too deep for it): such a file imports nothing."""
    found = _Imported()
    try:
        found.visit(ast.parse(source))
    except Exception as e:  # one file must not end the job (MemoryError and RecursionError included)
        return [], f"{type(e).__name__}: {e}"
    return found.names, None


def serve() -> None:
    """The child: lists of sources come in, their names and errors go out, until the input ends."""
    while True:
        try:
            sources = pickle.load(sys.stdin.buffer)
        except EOFError:
            return
        pickle.dump([top_level_imports(s) for s in sources], sys.stdout.buffer)
        sys.stdout.buffer.flush()


class Parser:
    """``top_level_imports`` of lists of sources, by one child after the other."""

    def __init__(self):
        self.child: subprocess.Popen | None = None
        self.read = 0

    def __call__(self, sources: list[str]) -> list[tuple[list[str], str | None]]:
        size = sum(map(len, sources))
        if self.read + size > PARSER_BYTES:
            self.close()
        if self.child is None:
            root = str(Path(__file__).parents[2])  # the folder or the zip that holds the package
            run = "import sys; sys.path.insert(0, sys.argv[1]); from loglens.operators.import_names import serve; serve()"
            self.child = subprocess.Popen([sys.executable, "-S", "-c", run, root], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self.read += size
        try:
            pickle.dump(sources, self.child.stdin)
            self.child.stdin.flush()
            return pickle.load(self.child.stdout)
        except (EOFError, BrokenPipeError, pickle.UnpicklingError):
            raise RuntimeError(f"the parser ended with code {self.child.wait()}") from None

    def close(self) -> None:
        """Ends the child, if there is one."""
        child, self.child, self.read = self.child, None, 0
        if child is not None:
            try:
                child.stdin.close()
            except BrokenPipeError:
                pass
            child.stdout.close()
            child.wait()

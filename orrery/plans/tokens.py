"""A small token stream that the parsers share."""

from __future__ import annotations

import re


class Stream:
    def __init__(self, text: str, pattern: str):
        self.items: list[str] = []
        at = 0
        rx = re.compile(pattern, re.X)
        while at < len(text):
            m = rx.match(text, at)
            if not m:
                raise SyntaxError(f"can't read: {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.items.append(m[0])
            at = m.end()
        self.i = 0

    def peek(self, ahead: int = 0) -> str:
        j = self.i + ahead
        return self.items[j] if j < len(self.items) else ""

    def word(self, ahead: int = 0) -> str:
        return self.peek(ahead).upper()

    def next(self) -> str:
        if self.i >= len(self.items):
            raise SyntaxError("unexpected end")
        self.i += 1
        return self.items[self.i - 1]

    def take(self, *words: str) -> bool:
        """Consume these words if they come next."""
        if all(self.word(k) == w.upper() for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxError(f"expected {' '.join(words)}, found {self.peek()!r}")

    def over(self) -> bool:
        return self.i >= len(self.items)

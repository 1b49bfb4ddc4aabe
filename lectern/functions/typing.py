"""The typing session: what each key does to a lesson's characters and counters. Plain functions over one session."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

# Keys that are no characters, and what to do about errors.
ENTER, BACKSPACE, DELETE_WORD = "Enter", "Backspace", "DeleteWord"
OFF, LETTER, WORD = "off", "letter", "word"
PENDING, CORRECT, INCORRECT, CORRECTED = "pending", "correct", "incorrect", "corrected"
IDLE_MS = 5000


def word_start(text: str, index: int) -> int:
    return text.rfind(" ", 0, index) + 1 if index > 0 else 0


class Session:
    """Blocks in order, a place (block, char), states by character, extras by word, and keystroke counters."""

    def __init__(self, blocks: list[str], stop: str = OFF, floor: tuple[int, int] = (0, 0)):
        self.blocks, self.stop, self.floor, self.at = [b for b in blocks if b], stop, floor, floor
        self.states = [[PENDING] * len(b) for b in self.blocks]
        self.wrong = [[False] * len(b) for b in self.blocks]  # ever
        self.extras: dict = defaultdict(list)  # (block, word start): characters
        self.extra_words, self.unfinished = set(), set()
        self.total = self.correct = 0

    def count(self, right: bool) -> None:
        self.total += 1
        self.correct += right

    def word_is_right(self, block: int, start: int, stop: int) -> bool:
        """Now, whatever was typed before."""
        return not self.extras[block, start] and all(s in (CORRECT, CORRECTED) for s in self.states[block][start:stop])

    def word_was_wrong(self, block: int, start: int, stop: int) -> bool:
        return (block, start) in self.extra_words or any(self.wrong[block][start:stop])

    def key(self, key: str) -> None:
        if not self.blocks:
            return
        if len(key) == 1:
            self.char(key)
        elif key == ENTER:
            self.enter()
        elif key == BACKSPACE:
            self.backspace()
        elif key == DELETE_WORD:
            self.delete_word()

    def char(self, typed: str) -> None:
        block, c = self.at
        text = self.blocks[block]
        if c >= len(text):  # only Enter goes on from here
            self.count(False)
            if block + 1 < len(self.blocks):
                self.unfinished.add(block)
            return
        expected, start = text[c], word_start(text, c)
        right = typed == expected
        if right and expected == " " and self.stop == WORD and not self.word_is_right(block, start, c):
            return self.count(False)
        self.count(right)
        if right:
            self.states[block][c] = CORRECTED if self.wrong[block][c] and expected != " " else CORRECT
        elif self.stop == LETTER:
            return
        elif expected == " ":
            self.extras[block, start].append(typed)
            self.extra_words.add((block, start))
            return
        else:
            self.states[block][c] = INCORRECT
            self.wrong[block][c] = True
        self.at = (block, c + 1)

    def enter(self) -> None:
        block, c = self.at
        text = self.blocks[block]
        last = word_start(text, len(text))
        held = self.stop == WORD and not self.word_is_right(block, last, len(text))
        right = c == len(text) and block + 1 < len(self.blocks) and not held
        self.count(right)
        if right:
            self.unfinished.discard(block)
            self.at = (block + 1, 0)

    def backspace(self) -> None:
        block, c = self.at
        if c == len(self.blocks[block]) and block in self.unfinished:
            self.unfinished.discard(block)
        else:
            self.step_back()

    def step_back(self) -> None:
        """An extra of the word goes first, then a character; from a word's start or a block's the last one before it."""
        while self.at > self.floor:
            block, c = self.at
            start = word_start(self.blocks[block], c)
            if self.extras[block, start]:
                self.extras[block, start].pop()
                return
            if c > start:
                self.states[block][c - 1] = PENDING
                self.at = (block, c - 1)
                return
            if c > 0:
                self.at = (block, c - 1)
            elif block > 0 and block - 1 >= self.floor[0]:
                self.at = (block - 1, len(self.blocks[block - 1]))
            else:
                return

    def delete_word(self) -> None:
        block, c = self.at
        text = self.blocks[block]
        if c > 0:
            goal = (block, word_start(text, len(text[:c].rstrip(" "))))
        elif block > 0:
            goal = (block - 1, word_start(self.blocks[block - 1], len(self.blocks[block - 1])))
        else:
            goal = self.at
        goal = max(goal, self.floor)
        self.unfinished.discard(block)
        while self.at > goal or self.extras[self.at[0], word_start(self.blocks[self.at[0]], self.at[1])]:
            before, extras = self.at, sum(map(len, self.extras.values()))
            self.step_back()
            if before == self.at and extras == sum(map(len, self.extras.values())):
                break

    def counts(self) -> dict:
        states = [s for own in self.states for s in own]
        return {"total": self.total, "right": self.correct, "block": self.at[0], "char": self.at[1], **{s: states.count(s) for s in (CORRECT, INCORRECT, CORRECTED, PENDING)}, "extras": sum(map(len, self.extras.values()))}


def active_ms(times: list[int], idle: int = IDLE_MS, paused: int | None = None) -> int:
    """Time on the clock: gaps between activities up to the idle limit; a pause adds its own gap at the end."""
    times = sorted(times) + ([paused] if paused is not None else [])
    return sum(min(b - a, idle) for a, b in zip(times, times[1:], strict=False))


def samples(times: list[int], keys: list[bool], idle: int = IDLE_MS, step: int = 1000) -> list[float]:
    """Raw words a minute of each full step while the clock runs; ticks count from the first activity. Times come in order."""
    if not times:
        return []
    out, typed = [], [0, *accumulate(map(int, keys))]
    for tick in range(times[0] + step, times[-1] + 1, step):
        upto = bisect_left(times, tick)
        if tick - times[upto - 1] < idle:
            out.append((typed[upto] - typed[bisect_left(times, tick - step)]) / 5 / (step / 60000))
    return out


class Reader:
    """A typing session through a planned book: a lesson that is typed to its end gives a result, and the next one begins.

    `results` are (start, end, keystrokes, right ones, active milliseconds, outcome). A skipped lesson has no result.
    """

    def __init__(self, book, target: int, start=(0, 0, 0), stop: str = OFF, idle: int = IDLE_MS):
        self.book, self.target, self.idle, self.results, self.times = book, target, idle, [], []
        self.places = book.open
        self.session = Session([book.text(p) for p in self.places], stop)
        self.anchor = book.anchor(start, target)
        self._go(self.anchor.start)

    def _go(self, position) -> None:
        self.session.at = self.session.floor = (self.places.index(position[:2]), position[2])

    def position(self) -> tuple[int, int, int]:
        k, c = self.session.at
        return (*self.places[k], c)

    def finished(self) -> bool:
        return not self.places or self.anchor.end <= self.anchor.start

    def key(self, key: str, at_ms: int) -> None:
        if self.finished():
            return
        self.times.append(at_ms)
        self.session.key(key)
        if self.position() == self.anchor.end and self.session.total:
            self.results.append((self.anchor.start, self.anchor.end, self.session.total, self.session.correct, active_ms(self.times, self.idle), "completed"))
            self._next()

    def _next(self) -> None:
        end = self.anchor.end
        self.anchor = self.book.anchor(end, self.target)
        self.session.total = self.session.correct = 0
        self.times = []
        if not self.finished():
            self._go(self.anchor.start)

    def skip(self) -> None:
        """To the next lesson; what was typed of this one counts for nothing here."""
        if not self.finished():
            self.results.append((self.anchor.start, self.anchor.end, 0, 0, 0, "skipped"))
            self._next()

    def restart(self) -> None:
        """The lesson from its start; its counters are new."""
        self.session.total = self.session.correct = 0
        self.times = []
        for k in range(len(self.places)):
            if self.anchor.start[:2] <= self.places[k] <= self.anchor.end[:2]:
                n = len(self.session.blocks[k])
                self.session.states[k], self.session.wrong[k] = [PENDING] * n, [False] * n
        self.session.extras.clear()
        self._go(self.anchor.start)

    def partial(self, paused_ms: int) -> tuple[int, int, int]:
        """Keystrokes, right ones and active time of a lesson that is left before its end; the bookmark does not move."""
        return self.session.total, self.session.correct, active_ms(self.times, self.idle, paused_ms)

"""What one key remembers while its hits pass in order: shared by batch passes and streams.

Every fold keeps ``rows``, a list of (time, value, item), and ``add`` returns
the rows that make the rule fire at a hit, or None. Rows are added at the end
and taken away at the front; ``gone`` counts those taken away.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Sequence

from .rules import Rule

Row = tuple[int, str | None, object]


class Single:
    """A match rule: every hit fires."""

    def __init__(self, rule: Rule, rows: Iterable[Row] = ()) -> None:
        self.rows: Sequence[Row] = ()
        self.gone = 0

    def add(self, ts: int, value: str | None, steps: Sequence[bool], item: object) -> list[Row]:
        return [(ts, value, item)]

    def restart(self) -> None: ...


class Trail:
    """A sequence rule: the hits of a sequence begun. ``plan`` names the step that each hit in turn must satisfy."""

    def __init__(self, rule: Rule, rows: Iterable[Row] = ()) -> None:
        self.plan = [i for i, s in enumerate(rule.steps) for _ in range(max(1, s.count))]
        self.span, self.rows, self.gone = rule.window * 1_000_000, list(rows), 0

    def add(self, ts: int, value: str | None, steps: Sequence[bool], item: object) -> list[Row] | None:
        if self.rows and ts - self.rows[0][0] > self.span:
            self.gone += len(self.rows)
            self.rows = []
        if not steps[self.plan[len(self.rows)]]:
            return None
        self.rows.append((ts, value, item))
        if len(self.rows) < len(self.plan):
            return None
        whole, self.rows = self.rows, []
        self.gone += len(whole)
        return whole

    def restart(self) -> None: ...


class Recent:
    """A threshold or distinct-count rule: the hits of the window, since the last alert."""

    def __init__(self, rule: Rule, rows: Iterable[Row] = ()) -> None:
        self.rule, self.span, self.rows, self.gone = rule, rule.window * 1_000_000, deque(rows), 0
        self.values = Counter(v for _, v, _ in self.rows if v is not None)

    def add(self, ts: int, value: str | None, steps: Sequence[bool], item: object) -> list[Row] | None:
        self.rows.append((ts, value, item))
        if value is not None:
            self.values[value] += 1
        while self.rows[0][0] < ts - self.span:
            _, old, _ = self.rows.popleft()
            self.gone += 1
            if old is not None:
                self.values[old] -= 1
                if not self.values[old]:
                    del self.values[old]
        size = len(self.rows) if self.rule.type == "threshold" else len(self.values)
        return list(self.rows) if size >= self.rule.threshold else None

    def restart(self) -> None:
        self.gone += len(self.rows)
        self.rows.clear()
        self.values.clear()


def fold_of(rule: Rule, rows: Iterable[Row] = ()) -> Single | Trail | Recent:
    return {"match": Single, "sequence": Trail}.get(rule.type, Recent)(rule, rows)

"""State machines over ordered timing events of one key.

Each machine is a plain class: ``step(event) -> row`` with its state in
attributes that ``vars`` can save.  ``tessella.streaming.runner`` drives them,
over a finished table or over a stream.
"""

from __future__ import annotations

from collections import OrderedDict
from heapq import heappop, heappush
from statistics import median

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Settings of the machines.
PROBE_MS, SPEEDUP, BLEND, REPROBE, REPROBE_SEARCH = 5.0, 1.12, 0.25, 64, 32
AGE_MS, HIGH_OBSERVATIONS, WORTH = 300_000, 3, 1.10
EQUIVALENCE, EQUIVALENT_MS, WARMUP, MINIMUM, WINDOW, HOLDOUT, FAILURES = 1.05, 0.001, 2, 3, 11, 2, 2
FIRST_INTERVAL, LAST_INTERVAL, DRIFT, DRIFT_MS, STRIKES = 8, 128, 1.25, 0.002, 2
HYSTERESIS = 0.08
EXPLORE, GAP, REGRET, COOLDOWN = 0.05, 0.08, 10.0, 32
BYPASSES, RESERVE_MS = 8, 50


class HotDispatch:
    """Scheduled or sequential: each is probed once, the faster one stays, and the other is probed again now and then.

    Events carry what both routes would take: ``scheduled_ms``, ``sequential_ms``.
    """

    def __init__(self, search: bool = False):
        self.interval = REPROBE_SEARCH if search else REPROBE
        self.mean = {"scheduled": 0.0, "sequential": 0.0}
        self.count = {"scheduled": 0, "sequential": 0}
        self.stable = ""
        self.uses = 0

    def _route(self) -> tuple[str, bool]:
        if not self.stable:
            if not self.count["scheduled"]:
                return "scheduled", True
            if not self.count["sequential"] and self.mean["scheduled"] <= PROBE_MS:
                return "sequential", True
            self._settle()
            return self.stable, False  # a route that has just settled has not been used yet
        self.uses += 1
        if self.uses >= self.interval:
            self.uses = 0
            other = "scheduled" if self.stable == "sequential" else "sequential"
            if other == "scheduled" or self.mean["scheduled"] <= PROBE_MS:
                return other, True
        return self.stable, False

    def _settle(self) -> None:
        scheduled, sequential = self.mean["scheduled"], self.mean["sequential"]
        wins = not self.count["sequential"] or (scheduled > 0 and sequential / scheduled >= SPEEDUP)
        self.stable = "scheduled" if wins else "sequential"
        self.uses = 0

    def step(self, event: dict) -> dict:
        route, probe = self._route()
        ms = event[f"{route}_ms"]
        self.mean[route] = ms if not self.count[route] else self.mean[route] * (1 - BLEND) + ms * BLEND
        self.count[route] += 1
        if probe and all(self.count.values()):
            self._settle()
        return {"route": route, "probe": probe, "stable": self.stable, "elapsed_ms": ms}


class ProfileCache:
    """A blended profile with generations; evidence that contradicts the class starts it anew, age asks for a check."""

    def __init__(self):
        self.cost = self.worth = 0.0
        self.observations = self.generation = 0
        self.updated = None

    def step(self, event: dict) -> dict:
        stale = self.updated is not None and event["ms"] - self.updated >= AGE_MS
        fresh = not self.observations or (self.worth >= WORTH) != (event["worth"] >= WORTH)
        if fresh:
            self.cost, self.observations = event["cost"], 1
        else:
            self.cost = self.cost * (1 - BLEND) + event["cost"] * BLEND
            self.observations += 1
        self.worth = event["worth"]
        self.generation += 1
        self.updated = event["ms"]
        return {"cost": self.cost, "observations": self.observations, "generation": self.generation, "stale": stale, "confidence": "High" if self.observations >= HIGH_OBSERVATIONS else "Medium"}


class BackendCalibration:
    """Mean by backend; a backend wins by 8 % or the thread pool stays.  Frozen, it learns no more."""

    def __init__(self):
        self.mean = {"ThreadPool": 0.0, "OneTbb": 0.0}
        self.count = {"ThreadPool": 0, "OneTbb": 0}
        self.winner = ""
        self.frozen = False

    def step(self, event: dict) -> dict:
        if event["backend"] == "freeze":
            self.frozen = True
        elif event["backend"] in self.mean and not self.frozen:
            b = event["backend"]
            self.count[b] += 1
            self.mean[b] += (event["elapsed_ms"] - self.mean[b]) / self.count[b]
            if all(self.count.values()):
                self.winner = "OneTbb" if self.mean["OneTbb"] < self.mean["ThreadPool"] * (1 - HYSTERESIS) else "ThreadPool"
        return {"winner": self.winner, "pool_ms": self.mean["ThreadPool"], "tbb_ms": self.mean["OneTbb"]}


def hash_unit(key: int, turn: int) -> float:
    """A uniform number from a key and a turn, the same in every run."""
    mask = (1 << 64) - 1
    x = (key ^ (turn * 0x9E3779B97F4A7C15)) & mask
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & mask
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


class Exploration:
    """Now and then a plan that scores almost as well is tried; one that does harm brings a pause.

    Events: ``key``, ``best``, ``scores`` ({plan: score}), ``actual_ms``, ``expected_ms``.
    """

    def __init__(self):
        self.pause = self.turns = self.tries = self.harmful = 0

    def step(self, event: dict) -> dict:
        best = event["scores"][event["best"]]
        plan, explored = event["best"], False
        if self.pause:
            self.pause -= 1
        else:
            near = sorted(p for p, s in event["scores"].items() if p != event["best"] and 0 < s <= best * (1 + GAP))
            if near:
                self.turns += 1
                if hash_unit(event["key"], self.turns) < EXPLORE:
                    plan, explored = near[self.tries % len(near)], True
                    self.tries += 1
        if explored and event["expected_ms"] > 0 and (event["actual_ms"] / event["expected_ms"] - 1) * 100 > REGRET:
            self.harmful += 1
            self.pause = COOLDOWN
        return {"plan": plan, "explored": explored, "pause": self.pause, "harmful": self.harmful}


def _middle(xs) -> float:
    return sorted(xs)[len(xs) // 2] if xs else 0.0


def _radius(xs) -> float:
    m = _middle(xs)
    return max(EQUIVALENT_MS, 2 * _middle([abs(x - m) for x in xs]))


def _margin(ms: float) -> float:
    return max(EQUIVALENT_MS, ms * (EQUIVALENCE - 1))


class RouteSelector:
    """Warm-up, learning by elimination, a hold-out duel, then one stable route that is checked at growing intervals.

    Routes stand in the order of preference: of routes that are equivalent the
    earlier one is taken.  Events carry the time of each route.
    """

    def __init__(self, routes: list[str]):
        self.routes = list(routes)
        self.warm = dict.fromkeys(routes, 0)
        self.samples = {r: [] for r in routes}
        self.active = list(routes)
        self.target = MINIMUM
        self.phase = "warmup"
        self.duel: dict[str, list[float]] = {}
        self.failures = 0
        self.stable = ""
        self.uses = self.strikes = self.turn = 0
        self.interval = FIRST_INTERVAL
        self.baseline = 0.0
        self.check: list[tuple[str, float]] = []
        self.pending: list[str] = []
        self.switches = 0

    # learning

    def _fastest(self, among: list[str]) -> str:
        return min(among, key=lambda r: (_middle(self.samples[r]), self.routes.index(r)))

    def _preferred(self, among: list[str]) -> str:
        best = self._fastest(among)
        ms = _middle(self.samples[best])
        allowed = [r for r in among if _middle(self.samples[r]) <= ms + _margin(ms) + max(_radius(self.samples[best]), _radius(self.samples[r]))]
        return min([*allowed, best], key=self.routes.index)

    def _learned(self) -> None:
        if any(len(self.samples[r]) < self.target for r in self.active):
            return
        best = self._fastest(self.active)
        ms = _middle(self.samples[best])
        high = ms + _radius(self.samples[best])
        out = [r for r in self.active if r != best and max(0.0, _middle(self.samples[r]) - _radius(self.samples[r])) > high + _margin(ms)]
        self.active = [r for r in self.active if r not in out]
        unsure = any(r != best and _middle(self.samples[r]) > ms + _margin(ms) for r in self.active)
        if unsure and len(self.active) > 1 and self.target < WINDOW:
            self.target = min(WINDOW, self.target + 2)
            return
        first = self._preferred(self.active)
        rest = [r for r in self.routes if r != first and self.samples[r]]
        if not rest:
            self._settle(first)
            return
        self.phase, self.duel = "holdout", {first: [], self._fastest(rest): []}

    def _dueled(self) -> None:
        if any(len(x) < HOLDOUT for x in self.duel.values()):
            return
        (first, a), (other, b) = self.duel.items()
        slack = _margin(_middle(b)) + max(_radius(a), _radius(b))
        if _middle(a) <= _middle(b) + slack:
            self._settle(first)
            return
        self.failures += 1
        for r, xs in self.duel.items():
            self.samples[r] = (self.samples[r] + xs)[-WINDOW:]
        if self.failures >= FAILURES or min(len(self.samples[first]), len(self.samples[other])) >= WINDOW:
            self._settle(other if _middle(b) + _margin(_middle(b)) < _middle(a) else first)
            return
        self.phase, self.active, self.duel = "learning", [first, other], {}
        self.target = min(WINDOW, max(MINIMUM, min(len(self.samples[first]), len(self.samples[other])) + 2))

    def _settle(self, route: str) -> None:
        self.phase, self.stable, self.uses, self.interval = "stable", route, 0, FIRST_INTERVAL
        self.baseline = _middle(self.samples[route])

    # checks of the stable route: it, the challenger twice, and it again

    def _challenger(self) -> str:
        others = [r for r in self.routes if r != self.stable]
        self.turn += 1
        return others[(self.turn - 1) % len(others)]

    def _checked(self) -> None:
        stable = median(ms for r, ms in self.check if r == self.stable)
        rival = next(r for r, _ in self.check if r != self.stable)
        other = median(ms for r, ms in self.check if r == rival)
        margin = _margin(min(stable, other))
        same = abs(other - stable) <= margin
        if other + margin < stable or (same and self.routes.index(rival) < self.routes.index(self.stable)):
            self.stable, self.baseline, self.interval = rival, other, FIRST_INTERVAL
            self.switches += 1
        else:
            self.baseline = stable
            self.interval = min(LAST_INTERVAL, self.interval * 2)
        self.check, self.strikes, self.uses = [], 0, 0

    def step(self, event: dict) -> dict:
        kind = self.phase
        if self.phase == "warmup":
            route = min(self.routes, key=lambda r: (self.warm[r], self.routes.index(r)))
            self.warm[route] += 1
            if all(n >= WARMUP for n in self.warm.values()):
                self.phase = "learning"
        elif self.phase == "learning":
            route = min(self.active, key=lambda r: (len(self.samples[r]), self.routes.index(r)))
            self.samples[route] = (self.samples[route] + [event[route]])[-WINDOW:]
            self._learned()
        elif self.phase == "holdout":
            route = min(self.duel, key=lambda r: len(self.duel[r]))
            self.duel[route].append(event[route])
            self._dueled()
        elif self.pending:
            kind, route = "check", self.pending[0]
            self.pending = self.pending[1:]
            self.check.append((route, event[route]))
            if not self.pending:
                self._checked()
        else:
            route, ms = self.stable, event[self.stable]
            limit = max(self.baseline * DRIFT, self.baseline + DRIFT_MS)
            self.strikes = self.strikes + 1 if self.baseline > 0 and ms > limit else 0
            self.uses += 1
            if len(self.routes) > 1 and self.strikes >= STRIKES:
                kind, rival = "drift", self._challenger()
                self.check, self.pending = [(route, ms)], [rival, rival, self.stable]
            elif len(self.routes) > 1 and self.uses >= self.interval:
                rival = self._challenger()
                self.pending = [self.stable, rival, rival, self.stable]
        return {"phase": kind, "route": route, "stable": self.stable, "interval": self.interval, "switches": self.switches}


class Waiting:
    """Requests in the order of their arrival, found by place, identifier, deadline and least permits without a look at the others."""

    def __init__(self):
        self.turn = 0
        self.rows: OrderedDict[int, dict] = OrderedDict()
        self.by_id: dict[int, dict[int, None]] = {}
        self.by_need: dict[int, OrderedDict[int, None]] = {}
        self.due: list[tuple[int, int]] = []  # requests that are gone stay until their time

    def __len__(self) -> int:
        return len(self.rows)

    def add(self, r: dict) -> None:
        """An admissible request: it can be served from ``minimum`` permits on, an exact one, too."""
        self.turn += 1
        self.rows[self.turn] = r | {"turn": self.turn}
        self.by_id.setdefault(r["id"], {})[self.turn] = None
        self.by_need.setdefault(r["minimum"], OrderedDict())[self.turn] = None
        if r["policy"] == "deadline":
            heappush(self.due, (r["deadline"], self.turn))

    def remove(self, r: dict) -> None:
        turn = r["turn"]
        del self.rows[turn]
        for index, k in ((self.by_id, r["id"]), (self.by_need, r["minimum"])):
            del index[k][turn]
            if not index[k]:
                del index[k]

    def head(self) -> dict:
        return self.rows[next(iter(self.rows))]

    def all(self) -> list[dict]:
        return list(self.rows.values())

    def of(self, identifier: int) -> list[dict]:
        return [self.rows[t] for t in self.by_id.get(identifier, ())]

    def first_fit(self, free: int) -> dict | None:
        turns = [next(iter(turns)) for need, turns in self.by_need.items() if need <= free]
        return self.rows[min(turns)] if turns else None

    def expired(self, now: int) -> list[dict]:
        turns = []
        while self.due and self.due[0][0] <= now:
            turns.append(heappop(self.due)[1])
        return [self.rows[t] for t in sorted(turns) if t in self.rows]


class Governor:
    """Leases of a fixed budget: first come first served, with a bounded number of smaller requests let past the first.

    Events in the order of time: ``op`` (acquire, release, cancel, shutdown),
    ``ms``, ``id`` and, for acquire, ``requested``, ``minimum``, ``exact``,
    ``policy`` (wait, fail, deadline) and ``deadline``.  ``status`` answers the
    event's own request; ``outcomes`` are those of waiting requests that the
    event, or the time it comes at, brings to an end.  After a shutdown nothing
    is granted; leases may still be released.
    """

    def __init__(self, budget: int):
        self.budget = budget
        self.active = self.peak = 0
        self.waiting = Waiting()
        self.leases: dict[int, int] = {}
        self.closed = False
        self.counts = dict.fromkeys(("grants", "releases", "waits", "cancellations", "deadlines", "bypasses", "reservations"), 0)

    def _fit(self, r: dict) -> int:
        free = self.budget - self.active
        if r["exact"]:
            return r["requested"] if free >= r["requested"] else 0
        n = min(r["requested"], free)
        return n if n >= r["minimum"] else 0

    def _grant(self, r: dict, n: int) -> None:
        self.active += n
        self.peak = max(self.peak, self.active)
        self.leases[r["id"]] = n
        self.counts["grants"] += 1

    def _drop(self, gone: list[dict], status: str, counter: str | None = None) -> list[dict]:
        """End waiting requests without a lease."""
        for r in gone:
            self.waiting.remove(r)
        if counter:
            self.counts[counter] += len(gone)
        return [{"id": r["id"], "status": status} for r in gone]

    def _expired(self, now: int) -> list[dict]:
        return self._drop(self.waiting.expired(now), "DeadlineExpired", "deadlines")

    def _serve(self, now: int) -> list[dict]:
        served = []
        while self.waiting and self.active < self.budget and not self.closed:
            head = self.waiting.head()
            if n := self._fit(head):
                self.waiting.remove(head)
                self._grant(head, n)
                served.append({"id": head["id"], "status": "Granted"})
                continue
            if now - head["ms"] >= RESERVE_MS or head["passed"] >= BYPASSES:
                self.counts["reservations"] += not head["reserved"]
                head["reserved"] = True
            if head["reserved"]:
                break
            other = self.waiting.first_fit(self.budget - self.active)
            if other is None:
                break
            self.waiting.remove(other)
            self._grant(other, self._fit(other))
            served.append({"id": other["id"], "status": "Granted"})
            head["passed"] += 1
            self.counts["bypasses"] += 1
        return served

    def step(self, event: dict) -> dict:
        status, op, now = "", event["op"], event["ms"]
        outcomes = self._expired(now)
        if op == "release":
            if event["id"] in self.leases:
                self.active -= self.leases.pop(event["id"])
                self.counts["releases"] += 1
            status = "Released"
        elif op == "cancel":
            outcomes += self._drop(self.waiting.of(event["id"]), "Cancelled", "cancellations")
            status = "Cancelled"
        elif op == "shutdown":
            self.closed = True
            outcomes += self._drop(self.waiting.all(), "GovernorShuttingDown")
            status = "GovernorShuttingDown"
        elif (verdict := lease_verdict(event, self.budget)) != "Admissible":
            status = verdict
        elif self.closed:
            status = "GovernorShuttingDown"
        else:
            self.waiting.add(event | {"passed": 0, "reserved": False})
        served = self._serve(now)
        if op == "acquire" and not status:
            mine = self.waiting.of(event["id"])
            if any(x["id"] == event["id"] for x in served):
                status = "Granted"
            elif event["policy"] == "fail":
                self._drop(mine, "WouldBlock")
                status = "WouldBlock"
            else:
                self.counts["waits"] += 1
                status = "Waiting"
                if event["policy"] == "deadline" and now >= event["deadline"]:
                    self._drop(mine, "DeadlineExpired", "deadlines")
                    status = "DeadlineExpired"
        outcomes += [x for x in served if x["id"] != event["id"]]
        return {
            "status": status,
            "granted": self.leases.get(event["id"], 0) if op == "acquire" else 0,
            "active": self.active,
            "available": self.budget - self.active,
            "peak": self.peak,
            "leases": len(self.leases),
            "queued": len(self.waiting),
            "served": len(served),
            "oldest_ms": now - self.waiting.head()["ms"] if self.waiting else 0,
            "outcomes": outcomes,
            "shutting_down": self.closed,
            **self.counts,
        }


def lease_verdict(r: dict, budget: int) -> str:
    """What is wrong with a request whatever the load."""
    if r["minimum"] < 1 or r["requested"] < r["minimum"] or (r["exact"] and r["minimum"] != r["requested"]):
        return "InvalidRequest"
    if r["minimum"] > budget:
        return "ImpossibleRequest"
    return "InvalidRequest" if r["policy"] == "deadline" and not r["deadline"] else "Admissible"


def lease_outcome(budget: int, free: Column) -> Column:
    """What becomes of a request that meets ``free`` permits and no queue, over columns requested, minimum, exact, policy, deadline, ms, cancelled and closed.

    The checks stand in the order in which a governor makes them.
    """
    c = F.col
    invalid = (c("minimum") < 1) | (c("requested") < c("minimum")) | (c("exact") & (c("minimum") != c("requested")))
    fits = F.when(c("exact"), free >= c("requested")).otherwise(F.least("requested", free) >= c("minimum"))
    return (
        F.when(invalid, "InvalidRequest")
        .when(c("minimum") > budget, "ImpossibleRequest")
        .when((c("policy") == "deadline") & (F.coalesce("deadline", F.lit(0)) == 0), "InvalidRequest")
        .when(c("cancelled"), "Cancelled")
        .when(c("closed"), "GovernorShuttingDown")
        .when(fits, "Granted")
        .when(c("policy") == "fail", "WouldBlock")
        .when((c("policy") == "deadline") & (c("ms") >= c("deadline")), "DeadlineExpired")
        .otherwise("Waiting")
    )

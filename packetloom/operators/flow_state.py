"""Rules that read and change variables of a flow: ``flowbits`` and ``flowint``.

A rule with such options alerts on a packet that it matches itself, if its tests hold in the
flow's state at that packet; then its changes apply. The matched rows of a flow are taken in
order of time, packet, and inside a packet first the rules that only change, then by sid.

Variables that no rule tests are left out. The others fall into parts that no rule connects,
and each part of a flow is followed for itself. A part's variables have few states that tests
can tell apart (a counter beyond every tested number stays there), so what a run of rows does
is a small map from the state before to the state after. Flows with very many rows are cut
into pieces; their maps alone meet per flow, and give each piece the state it begins with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.timing import epoch_us
from packetloom.operators.ordered import KEY, PIECE, PIECE_ROWS, SLOT, STEP, key_pieces

#: States of a part up to which its flows can be cut into pieces.
MAX_STATES = 1024

# What the two options can say. An unset variable fails every comparison.
COMPARISONS: dict[str, Callable[[int, int], bool]] = {
    ">=": int.__ge__, "<=": int.__le__, ">": int.__gt__, "<": int.__lt__, "==": int.__eq__, "!=": int.__ne__,
}
SET_TESTS = {"isset": True, "isnotset": False, "notset": False}
BIT_CHANGES = ("set", "unset", "toggle")
NUMBER_CHANGES = ("+", "-", "=")


@dataclass(frozen=True)
class Step:
    """One option: a test or a change of ``names`` (several: any of them is set)."""

    op: str
    names: tuple[str, ...]
    value: int = 0
    test: bool = False


@dataclass
class StateRule:
    key: int
    sid: str
    steps: list[Step]
    part: int = -1

    @property
    def tests(self) -> list[Step]:
        return [s for s in self.steps if s.test]


def read_steps(options: Sequence[tuple[str, str]]) -> list[Step]:
    """Options as (name, value) in the order of the rule; an unreadable one is an error."""
    steps = []
    for option, text in options:
        words = [w.strip() for w in text.split(",")]
        if option == "flowbits" and words[0] in SET_TESTS and len(words) == 2:
            steps.append(Step(words[0], tuple(f"bit {w.strip()}" for w in words[1].split("|")), test=True))
        elif option == "flowbits" and words[0] in BIT_CHANGES and len(words) == 2:
            steps += [Step(words[0], (f"bit {w.strip()}",)) for w in words[1].split("|")]
        elif option == "flowbits" and words == ["noalert"]:
            continue
        elif option == "flowint" and len(words) == 2 and words[1] in SET_TESTS:
            steps.append(Step(words[1], (f"int {words[0]}",), test=True))
        elif option == "flowint" and len(words) == 3 and words[2].isdigit() and words[1] in (*COMPARISONS, *NUMBER_CHANGES):
            steps.append(Step(words[1], (f"int {words[0]}",), int(words[2]), words[1] in COMPARISONS))
        else:
            raise ValueError(f"cannot read {option}:{text}")
    return steps


@dataclass
class Part:
    """Variables that rules connect; ``most`` is the number from which a counter's values are alike."""

    names: list[str]
    rules: list[StateRule]
    most: dict[str, int] = field(default_factory=dict)
    states: list[tuple] | None = None

    def __post_init__(self):
        lowered = {n for r in self.rules for s in r.steps if s.op == "-" for n in s.names}
        for name in self.names:
            if name.startswith("int "):
                self.most[name] = 1 + max((s.value for r in self.rules for s in r.tests if name in s.names), default=0)
        sizes = [self.most[n] + 2 if n in self.most else 2 for n in self.names]
        if not lowered and np.prod([float(x) for x in sizes]) <= MAX_STATES:
            values = [[None, *range(self.most[n] + 1)] if n in self.most else [None, 1] for n in self.names]
            self.states = list(product(*values))
        else:
            self.most = {}

    def after(self, steps: list[Step], state: tuple) -> tuple[bool, tuple]:
        """Whether the tests hold, and the state then."""
        now = dict(zip(self.names, state))
        for s in steps:
            if not s.test:
                continue
            values = [now[n] for n in s.names]
            if s.op in SET_TESTS:
                holds = any(v is not None for v in values) == SET_TESTS[s.op]
            else:
                holds = values[0] is not None and COMPARISONS[s.op](values[0], s.value)
            if not holds:
                return False, state
        for s in steps:
            if s.test:
                continue
            name = s.names[0]
            if s.op in BIT_CHANGES:
                on = s.op == "set" or s.op == "toggle" and now[name] is None
                now[name] = 1 if on else None
            else:
                old = now[name] or 0
                new = s.value if s.op == "=" else old + s.value if s.op == "+" else max(old - s.value, 0)
                now[name] = min(new, self.most.get(name, new))
        return True, tuple(now[n] for n in self.names)


class Machine:
    """The rules of a catalog that read or change tested variables, in the order they are evaluated."""

    def __init__(self, rules: list[StateRule]):
        tested = {n for r in rules for s in r.tests for n in s.names}
        self.rules = []
        for r in rules:
            steps = [s for s in r.steps if s.test or set(s.names) & tested]
            if steps:
                self.rules.append(StateRule(r.key, r.sid, steps))
        self.rules.sort(key=lambda r: (bool(r.tests), int(r.sid) if r.sid.isdigit() else 0, r.sid, r.key))
        root = {n: n for r in self.rules for s in r.steps for n in s.names}

        def find(n: str) -> str:
            while root[n] != n:
                n = root[n]
            return n

        for r in self.rules:
            names = [n for s in r.steps for n in s.names]
            for n in names[1:]:
                root[find(n)] = find(names[0])
        heads = sorted({find(n) for n in root})
        self.parts = []
        for part, head in enumerate(heads):
            mine = [r for r in self.rules if find(r.steps[0].names[0]) == head]
            for r in mine:
                r.part = part
            self.parts.append(Part(sorted(n for n in root if find(n) == head), mine))

    def table(self, nth: int) -> tuple[list[bool], list[int]]:
        """For each state of the rule's part whether the rule fires, and the state after."""
        rule = self.rules[nth]
        part = self.parts[rule.part]
        place = {s: i for i, s in enumerate(part.states)}
        got = [part.after(rule.steps, s) for s in part.states]
        return [ok for ok, _ in got], [place[s] for _, s in got]

    def stepper(self) -> Callable[[int, object], tuple[bool, object]]:
        """(rule, state) to (fires, state after); a state is None at first, else a number or values."""
        tables = [self.table(i) if self.parts[r.part].states else None for i, r in enumerate(self.rules)]

        def step(nth: int, state):
            if tables[nth] is not None:
                fires, after = tables[nth]
                return fires[state or 0], after[state or 0]
            rule = self.rules[nth]
            part = self.parts[rule.part]
            return part.after(rule.steps, state or (None,) * len(part.names))

        return step


def state_machine(rules: DataFrame) -> Machine:
    """From a rule table; the rules with state options come to the driver, one row each."""
    rows = rules.where(F.size("state_options") > 0).select("rule_key", "sid", "state_options").collect()
    return Machine([StateRule(r.rule_key, r.sid, read_steps([tuple(o) for o in r.state_options])) for r in rows])


def evaluated(
    alerts: DataFrame,
    rules: DataFrame,
    flow: Sequence[str] = ("flow",),
    *,
    ts: str = "ts",
    tie: str = "packet_id",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Alerts whose rules' tests of flow variables hold; rules without such tests pass all.

    ``alerts`` has every matched row, those of ``noalert`` rules too, for they change variables; it
    is read two or three times, so give a written table where matching is costly. ``flow`` are the
    columns that name a flow. Flows of parts whose counters are lowered,
    or with more than ``MAX_STATES`` states, are followed whole, in one task each.
    """
    machine = state_machine(rules)
    if not machine.rules:
        return alerts
    spark = alerts.sparkSession
    known = spark.createDataFrame(
        [(r.key, i, r.part) for i, r in enumerate(machine.rules)], "_rule long, _nth int, _part int"
    )  # one row per rule of the catalog with state options
    others = alerts.join(known, F.col("rule_key") == F.col("_rule"), "left_anti")
    mine = alerts.join(known, F.col("rule_key") == F.col("_rule")).drop("_rule").withColumn("_us", epoch_us(F.col(ts)))
    whole = [i for i, p in enumerate(machine.parts) if p.states is None]
    placed, cut = key_pieces(mine, [*flow, "_part"], "_us", tie, piece_rows=piece_rows)
    if cut is not None:
        placed = placed.withColumn(STEP, F.when(F.col("_part").isin(whole), F.lit(0)).otherwise(F.col(STEP)))
    order = Window.partitionBy(*PIECE).orderBy("_us", tie, "_nth")
    numbered = placed.withColumn("_n", F.row_number().over(order))
    columns = [F.col(f"`{c}`") for c in alerts.columns]
    if cut is None:
        begun = numbered.withColumn("_start", F.lit(None).cast("int"))
    else:
        starts = _starts(numbered.join(cut, KEY, "left_semi").where(~F.col("_part").isin(whole)), machine)
        limits = starts.withColumnsRenamed({c: f"_at{c}" for c in PIECE})
        # the window keeps the order inside pieces, so starts join before it
        begun = placed.join(limits, [F.col(c) == F.col(f"_at{c}") for c in PIECE], "left")
        begun = begun.withColumn("_n", F.row_number().over(order))
    rows, names = begun.select("_n", "_nth", "_start", *columns), alerts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, state = machine.stepper(), None
        for batch in batches:
            fires = []
            for n, nth, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if n == 1:
                    state = start
                ok, state = step(nth, state)
                fires.append(ok)
            kept = batch.filter(pa.array(fires, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[3:], names=names)

    return rows.mapInArrow(run, alerts.schema).unionByName(others)


def _starts(rows: DataFrame, machine: Machine) -> DataFrame:
    """The state with which each piece of the divided flows begins: the pieces' maps, applied in turn."""
    schema = T.StructType([rows.schema[KEY], rows.schema[SLOT], rows.schema[STEP], T.StructField("map", T.ArrayType(T.IntegerType()))])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(machine.table(i)[1], np.int32) if machine.parts[r.part].states else None for i, r in enumerate(machine.rules)]
        head, now = None, None
        for batch in batches:
            done, where = [], []
            for i, (n, nth) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if n == 1:
                    if now is not None:
                        done.append(now)
                    where.append(i)
                    now = np.arange(len(tables[nth]), dtype=np.int32)
                now = tables[nth][now]
            # a piece's name goes out with its map, which may end in a later batch
            names = batch.select(names_of).take(pa.array(where, pa.int64()))
            heads = names if head is None else pa.concat_batches([head, names])
            yield _mapped(heads.slice(0, len(done)), done, schema)
            head = heads.slice(len(done))
        if now is not None:
            yield _mapped(head, [now], schema)

    names_of = list(PIECE)
    found = rows.select("_n", "_nth", *PIECE).mapInArrow(maps, schema)
    each = F.sort_array(F.collect_list(F.struct(SLOT, STEP, "map")))
    begin = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate(
        "pieces",
        begin,
        lambda a, x: F.struct(F.get(x["map"], a["s"]).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")),
    )
    folded = found.groupBy(KEY).agg(each.alias("pieces")).withColumn("starts", fold["out"])
    place = F.explode(F.arrays_zip("pieces", "starts")).alias("e")
    return folded.select(KEY, place).select(
        KEY, F.col(f"e.pieces.{SLOT}").alias(SLOT), F.col(f"e.pieces.{STEP}").alias(STEP), F.col("e.starts").alias("_start")
    )


def _mapped(names: pa.RecordBatch, maps: list[np.ndarray], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*names.columns, pa.array([m.tolist() for m in maps], pa.list_(pa.int32()))], names=schema.names)

"""Flows of both directions and rules on their variables, against plain re-computation."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest

from packetloom.operators import flow_state, flows, match, rule_options
from packetloom.plans.option_queries import option_rules
from packetloom.schema import PACKETS

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
A, B = ("10.0.0.1", 4000), ("10.0.0.2", 80)


def packet(i, seconds, forward=True, size=100, a=A, b=B, proto="tcp"):
    s, d = (a, b) if forward else (b, a)
    return (i, T0 + timedelta(seconds=seconds), s[0], d[0], proto, s[1], d[1], size, None)


def of(spark, rows):
    return spark.createDataFrame(rows, PACKETS)


def random_packets(n, seed, ends=3):
    rng, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 179.999999, 180, 400])
        k = rng.randrange(ends)
        rows.append(packet(i, at, rng.random() < 0.5, rng.randint(40, 400), a=(f"10.0.0.{k}", 4000), proto=rng.choice(["tcp", "TCP"])))
    return rows


def plain_flows(rows, idle=180):
    start, last, out = {}, {}, {}
    for p in sorted(rows, key=lambda p: (p[1], p[0])):
        key = (p[4].lower(), *sorted([(p[2], p[5] or -1), (p[3], p[6] or -1)], key=str))
        if key not in last or (p[1] - last[key]).total_seconds() >= idle:
            start[key] = p[1]
        last[key] = p[1]
        out[p[0]] = (key, start[key])
    return out


@pytest.mark.parametrize("piece_rows", [10, 1_000_000])
def test_flows_end_by_idle_time(spark, piece_rows):
    rows = random_packets(400, 1) + [packet(900 + i, 10_000 + i, a=("10.0.0.9", None), b=("10.0.0.8", None), proto="icmp") for i in range(3)]
    rows += [(1000, None, None, None, None, None, None, None, None)]
    want = plain_flows(rows[:-1])
    got = flows.with_flow(of(spark, rows), piece_rows=piece_rows).collect()
    assert len(got) == len(rows)
    names = {}
    for r in got:
        if r.packet_id != 1000:
            key, start = want[r.packet_id]
            assert (T0 + timedelta(microseconds=r.flow.start_us - int(T0.timestamp() * 1e6))) == start
            names.setdefault((key, start), set()).add(r.flow)
    assert all(len(n) == 1 for n in names.values())
    assert len({next(iter(n)) for n in names.values()}) == len(names)


def test_flow_table(spark):
    rows = [packet(1, 0, False, 10), packet(2, 1, True, 20), packet(3, 2, False, 30), packet(4, 500, True, 40)]
    got = sorted(flows.flow_table(flows.with_flow(of(spark, rows))).collect(), key=lambda r: r.first_ts)
    assert [(r.client.ip, r.packets_to_server, r.packets_to_client, r.bytes_to_server, r.bytes_to_client) for r in got] == [(B[0], 2, 1, 40, 20), (A[0], 1, 0, 40, 0)]


@pytest.mark.parametrize("named", [True, False])
def test_back_off_counts_both_directions(spark, named):
    rules = option_rules(spark, ('alert tcp any any -> any any (msg:"x"; threshold:type backoff, track by_flow, count 1, multiplier 10; sid:1;)',))
    rows = [packet(i, i, i % 2 == 0) for i in range(10)] + [packet(20 + i, 1000 + i, i % 2 == 1) for i in range(3)]
    packets = of(spark, rows)
    alerts = match.match_packets(flows.with_flow(packets), rules, keep=["flow"]) if named else match.match_packets(packets, rules)
    fired = sorted(r.packet_id for r in rule_options.limited(alerts, rules).collect())
    assert fired == ([0, 9, 20] if named else [0, 9])  # without a flow column flows never end


def plain_state(rows, lines, rules):
    """Evaluates the lines with dictionaries; a line is (sid, matches, steps as text)."""
    state, fired = {}, set()
    names = plain_flows(rows)
    order = sorted(lines, key=lambda x: (any(s.split(",")[0] in ("isset", "isnotset") or s.split(",")[1] in flow_state.COMPARISONS for s in x[2]), x[0]))
    for p in sorted(rows, key=lambda p: (p[1], p[0])):
        now = state.setdefault(names[p[0]], {})
        for sid, matches, steps in order:
            if not matches(p[7]):
                continue
            ok = True
            for s in steps:
                w = s.split(",")
                if w[0] == "isset":
                    ok &= any(v in now for v in w[1].split("|"))
                elif w[0] == "isnotset":
                    ok &= w[1] not in now
                elif w[1] in flow_state.COMPARISONS:
                    ok &= w[0] in now and eval(f"{now[w[0]]} {w[1]} {w[2]}")
            if not ok:
                continue
            fired.add((p[0], str(sid)))
            for s in steps:
                w = s.split(",")
                if w[0] == "set" or w[0] == "toggle" and w[1] not in now:
                    now[w[1]] = True
                elif w[0] in ("unset", "toggle"):
                    now.pop(w[1], None)
                elif w[1] in ("+", "-", "="):
                    old = now.get(w[0], 0)
                    now[w[0]] = int(w[2]) if w[1] == "=" else max(old + (1 if w[1] == "+" else -1) * int(w[2]), 0)
    return fired


LINES = [
    (1, ">", 350, ["set,big"]), (2, "<", 80, ["isset,big", "unset,big"]), (3, ">", 200, ["isnotset,big"]), (4, "<", 120, ["n,+,2"]),
    (5, ">", 100, ["n,>=,7", "isnotset,told", "set,told"]), (6, ">", 390, ["n,=,0"]), (7, "<", 300, ["n,<,3", "toggle,odd"]), (8, ">", 250, ["isset,odd|big"]),
    (9, ">", 50, ["lone,+,1"]), (10, ">", 300, ["free,==,2", "free,=,9"]), (11, "<", 200, ["free,+,1"]), (12, ">", 380, ["n,!=,4"]),
]
LOWERED = [(21, "<", 200, ["m,+,3"]), (22, ">", 250, ["m,-,2"]), (23, ">", 150, ["m,>=,5", "set,high"]), (24, "<", 90, ["isset,high"])]


def rule_text(sid, op, n, steps):
    options = "; ".join(f"{'flowbits' if s.split(',')[0] in ('set', 'unset', 'toggle', 'isset', 'isnotset') else 'flowint'}:{s}" for s in steps)
    return f'alert tcp any any -> any any (msg:"r{sid}"; dsize:{op}{n}; {options}; sid:{sid};)'


@pytest.mark.parametrize("piece_rows", [7, 1_000_000])
@pytest.mark.parametrize("lines", [LINES, LINES + LOWERED])
def test_state_of_flows(spark, piece_rows, lines):
    rng, rows, at = random.Random(5), [], 0
    for i in range(500):
        at += rng.choice([0, 0, 1, 30]) if i % 120 else 300
        k = 0 if rng.random() < 0.7 else rng.randint(1, 4)
        rows.append(packet(i, at, rng.random() < 0.5, rng.randint(40, 400), a=(f"10.0.1.{k}", 4000)))
    more = 'alert tcp any any -> any any (msg:"plain"; dsize:>395; sid:99;)'
    rules = option_rules(spark, (*(rule_text(*x) for x in lines), more))
    alerts = match.match_packets(flows.with_flow(of(spark, rows)), rules, keep=["flow"])
    got = flow_state.evaluated(alerts, rules, piece_rows=piece_rows)
    assert got.columns == alerts.columns
    test = {">": lambda n: lambda size: size > n, "<": lambda n: lambda size: size < n}
    want = plain_state(rows, [(sid, test[op](n), steps) for sid, op, n, steps in lines], rules)
    want |= {(p[0], "99") for p in rows if p[7] > 395}
    assert {(r.packet_id, r.sid) for r in got.collect()} == want


def test_parts_and_states(spark):
    machine = flow_state.state_machine(option_rules(spark, tuple(rule_text(*x) for x in LINES + LOWERED)))
    states = {tuple(p.names): p.states and len(p.states) for p in machine.parts}
    assert states == {("bit big", "bit odd", "bit told", "int n"): 8 * 10, ("int free",): 5, ("bit high", "int m"): None}
    assert "9" not in {r.sid for r in machine.rules}  # its counter is never tested


@pytest.mark.parametrize("option", ["flowint:a,*,2", "flowint:a,+,b", "flowbits:maybe,x", "flowbits:isset"])
def test_unreadable_options_are_errors(spark, option):
    rules = option_rules(spark, (f"alert tcp any any -> any any (msg:\"x\"; {option}; sid:1;)",))
    with pytest.raises(ValueError, match="cannot read"):
        flow_state.state_machine(rules)


def test_no_state_rules_and_no_rows(spark):
    rules = option_rules(spark, ('alert tcp any any -> any any (msg:"x"; sid:1;)', rule_text(*LINES[1])))
    packets = flows.with_flow(of(spark, []))
    alerts = match.match_packets(packets, rules, keep=["flow"])
    assert flow_state.evaluated(alerts, rules).collect() == []
    assert flow_state.evaluated(alerts, rules.where("sid = '1'")).collect() == []

"""Rule text, indicator lists, signatures and address expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from packetloom.functions.net import cidr_bounds, decode_payload, host_of, ip_number, parent_domain
from packetloom.functions.score import display_colour, severity
from packetloom.sources import intel, rules, signatures

LINES = [
    'alert tcp any any -> any any (msg:"A b: c (x)"; content:"one"; content:"two"; noalert; dsize:>400; sid:9000001; rev:1;)',
    'alert dnp3 any any -> any any (msg:"multi"; \\',
    '   dnp3.event; classtype:never; sid:77;)',
    'alert tcp any any -> any any (content:!"neg"; msg:"semi;colon"; sid:4;)',
    'drop tcp any any -> any any (msg:"d"; sid:2;)',
    'alert tcp any (msg:"short"; sid:3;)',
    "# alert tcp x",
    "",
    "   ",
    "404: Not Found",
    "\talert udp any any -> any any (dsize:<x; sid:5;)",
    "alert udp any any -> any any (dsize:300<>400; sid:6;)",
    "alert udp any any -> any any (dsize:> 400; msg:\"spaced\"; sid:7;)",
    "alert udp any any -> any any (dsize:>99999999999; sid:8;)",
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([("f.rules", x) for x in LINES], "rule_file string, line string")
    return {r["msg"] or r["sid"]: r for r in rules.parse_rules(rules.clean_lines(lines)).collect()}


def test_options_keep_the_last_value_and_drop_flags(parsed):
    assert parsed["A b: c (x)"]["options"] == {
        "msg": "A b: c (x)",
        "content": "two",
        "dsize": ">400",
        "sid": "9000001",
        "rev": "1",
    }
    assert parsed["A b: c (x)"]["noalert"] and not parsed["semi"]["noalert"]


def test_two_line_rule_keeps_its_first_line(parsed):
    assert parsed["multi"]["options"] == {"msg": "multi"}
    assert parsed["multi"]["sid"] is None


def test_semicolon_in_quotes_cuts_and_negation_keeps_its_quote(parsed):
    assert parsed["semi"]["options"] == {"content": '!"neg', "msg": "semi", "sid": "4"}


def test_rejected_lines(parsed):
    assert set(parsed) == {"A b: c (x)", "multi", "semi", "6", "spaced", "8"}


def test_sizes(parsed):
    sizes = {k: (r["dsize_op"], r["dsize_n"]) for k, r in parsed.items()}
    assert sizes["A b: c (x)"] == (">", 400)
    assert sizes["6"] == (None, None)  # other forms never filter
    assert sizes["spaced"] == (">", 400)
    assert sizes["8"] == (">", 99999999999)


def test_rule_folder(spark, tmp_path):
    (tmp_path / "a.rules").write_text("\n".join(LINES))
    (tmp_path / "b.rules").write_text(LINES[0] + "\n" + LINES[0] + "\n")
    (tmp_path / "c.txt").write_text(LINES[0])
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.rules").write_text(LINES[0])
    loaded = rules.load_rules(spark, str(tmp_path))
    per_file = rules.rules_per_file(rules.parse_rules(rules.rule_lines(spark, str(tmp_path))))
    assert {r[0]: r[1] for r in per_file.collect()} == {"a.rules": 6, "b.rules": 2}
    got = loaded.collect()
    assert len(got) == 8 and len({r["rule_key"] for r in got}) == 8
    multi = [r for r in got if r["msg"] == "multi"][0]
    assert (multi["sid"], multi["rule_class"]) == ("0", "unknown")
    assert [r for r in got if r["sid"] == "6"][0]["msg"] == "Suspicious traffic detected"


def test_missing_rule_folder(spark, tmp_path):
    assert rules.rule_lines(spark, str(tmp_path / "none")).count() == 0


def test_references(spark):
    line = 'alert tcp any any -> any any (msg:"m"; reference:cve,2014-1; reference:url,a.b/c,d; sid:1;)'
    df = spark.createDataFrame([("1", line)], "sid string, line string")
    got = {(r["ref_type"], r["ref_id"]) for r in rules.references(df, "sid").collect()}
    assert got == {("cve", "2014-1"), ("url", "a.b/c,d")}


def test_variables_resolve_inside_each_other():
    got = rules.resolve_variables({"WEB": "[80,$TLS]", "TLS": "[443,8443]", "NOT_WEB": "!$WEB"})
    assert got["WEB"] == "[80,443,8443]" and got["NOT_WEB"] == "![80,443,8443]"
    with pytest.raises(ValueError):
        rules.resolve_variables({"A": "$B", "B": "$A"})


IP_TEXT = """# heading

10.0.0.1
 10.0.0.1
# block
10.1.0.0/24
10.0.0.2
"""


def test_indicator_lists(spark, tmp_path):
    ips, names = tmp_path / "ips.txt", tmp_path / "names.txt"
    ips.write_text(IP_TEXT)
    names.write_text("# names\nbad.example\n\nworse.example\nbad.example\n")
    clean = intel.load_indicators(spark, str(ips), str(names))
    counts = {r["kind"]: r["indicators"] for r in intel.indicator_counts(clean).collect()}
    assert counts == {"ip": 2, "cidr": 1, "domain": 2}
    raw = intel.load_indicators(spark, str(ips), str(names), keep_raw=True)
    counts = {r["kind"]: r["indicators"] for r in intel.indicator_counts(raw).collect()}
    assert counts == {"ip": 6, "domain": 4}


def test_threat_intel_table(spark, tmp_path):
    path = str(tmp_path / "ti")
    spark.sql(
        "select 1L id, timestamp'2024-01-01' timestamp, '1.2.3.4' ip_address, cast(null as string) domain,"
        " 'c2' threat_type, 90 confidence, 'feed' source, 'extra' other"
    ).write.parquet(path)
    got = intel.threat_intel_table(spark, path)
    assert got.columns == ["id", "timestamp", "ip_address", "domain", "threat_type", "confidence", "source"]
    assert got.first()["confidence"] == 90


SIGNATURES = r'''
/* licence text
rule not_a_rule { condition: true } */
rule first_kit : EK Web
{
meta:
   author = "someone"
   date = "2001-02-03"
strings:
   $string0 = "own;text 7"
    $string1 = "say \"hi\" {x}"
   $string2 = "rule inside text"
condition:
   2 of them
}
rule second_kit
{
    strings:
        $a = /\.php\?[a-z]{2,}/
    condition:
        $a
}
private rule third : X { strings:
  $a = "one"
  $b = "two"
condition: all of them }
'''


def test_signature_text(spark, tmp_path):
    (tmp_path / "kit.yar").write_text(SIGNATURES)
    got = {
        r["name"]: r
        for r in signatures.signatures(signatures.signature_files(spark, str(tmp_path))).collect()
    }
    assert set(got) == {"first_kit", "second_kit", "third"}
    first = got["first_kit"]
    assert first["tags"] == ["EK", "Web"] and first["k"] == 2
    assert first["meta"] == {"author": "someone", "date": "2001-02-03"}
    assert first["strings"] == ["own;text 7", 'say "hi" {x}', "rule inside text"]
    assert got["second_kit"]["k"] is None and got["second_kit"]["strings"] == []
    assert got["third"]["k"] == 2 and got["third"]["tags"] == ["X"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_addresses(spark):
    got = one(
        spark,
        ip_number(F.lit("10.0.1.2")),
        ip_number(F.lit("256.0.0.1")),
        ip_number(F.lit("fe80::1")),
        ip_number(F.lit("255.255.255.255")),
        *cidr_bounds(F.lit("45.146.164.77/24")),
        *cidr_bounds(F.lit("1.2.3.4")),
        *cidr_bounds(F.lit("0.0.0.0/0")),
        cidr_bounds(F.lit("1.2.3.4/33"))[0],
    )
    assert list(got) == [
        167772418, None, None, 4294967295,
        764584960, 764585215, 16909060, 16909060, 0, 4294967295, None,
    ]


def test_hosts(spark):
    got = one(
        spark,
        host_of(F.lit("https://a.b.example.com:8080/x?y")),
        host_of(F.lit("not a url at all")),
        parent_domain(F.lit("a.b.example.com")),
    )
    assert list(got) == ["a.b.example.com", None, "example.com"]


def test_invalid_bytes_are_left_out(spark):
    raw = F.concat(F.lit(b"ab"), F.lit(b"\xff\xfe"), F.lit("é".encode()), F.lit(b"\xc3"))
    assert one(spark, decode_payload(raw))[0] == "abé"


@pytest.mark.parametrize(
    "score,band,colour",
    [(20, "low", "green"), (21, "medium", "green"), (50, "medium", "green"), (51, "high", "yellow"),
     (100, "high", "yellow"), (101, "critical", "red"), (None, None, "green"), (0, "low", "green")],
)
def test_bands(spark, score, band, colour):
    s = F.lit(score).cast("int")
    assert list(one(spark, severity(s), display_colour(s))) == [band, colour]

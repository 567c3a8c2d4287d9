"""Ownership of credential-like strings: both counts decide."""

from platewise.llm import secrets


def test_both_counts_decide(spark):
    hot, live, again = "Zx9Qw8Er7Ty6Ui5Op4As3", "Ab1Cd2Ef3Gh4Ij5Kl6Mn7", "Qa1Ws2Ed3Rf4Tg5Yh6Uj7"
    rows = [(i, f"copy {hot}", "s1") for i in range(60)] + [(100 + i, f"key {live}", f"s{i}") for i in range(3)] + [(200, f"own {again}", "s1")] * 30
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[0].spans, got[0].n_copied, got[0].carriers) == ("", 1, "own:5:26:60:1:copied")
    assert (got[100].spans, got[100].n_copied, got[100].carriers) == ("owned:4:25", 0, "own:4:25:3:3:live")
    assert (got[200].spans, got[200].carriers) == ("owned:4:25", "own:4:25:1:1:live")


def test_base_spans_are_told_live_or_copied_and_match_a_slow_scan(spark):
    import collections
    import hashlib
    import re

    key = "AKIA" + "ABCD" * 4
    rows = [(i, f"{'x' * i} {key} password = hunter{i % 2}22 ", f"s{i % 5}") for i in range(30)] + [(90, "Secret:'a.b/c+d_e' " + "0a" * 12 + f" {key}9", "s1"), (91, None, None), (92, "", None), (93, "token=abc", "q"), (94, "y " * 200_000 + "token=abcdef", "q")]
    got = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame([(*r, "", 0) for r in rows], "doc_id long, text string, source string, base string, n_live int")).collect()}
    slow = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
        "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+"),
    }
    least, carried = {"assign": 6, "access": 20, "hex": 24}, collections.defaultdict(set)
    base = {}
    for i, text, owner in rows:
        base[i] = []
        for order, (kind, pattern) in enumerate(slow.items()):
            for m in pattern.finditer(text or ""):
                value = m[2] if kind == "assign" else m[0]
                if len(value) >= least[kind]:
                    base[i].append((m.start(), order, m.end(), kind, value))
                    carried[value].add((i, owner))
    for i, spans in base.items():
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and got[i].spans == listed
        want = []
        for a, _, b, k, value in sorted(spans):
            docs, owners = len(carried[value]), len({o for _, o in carried[value]})
            want.append(f"{k}:{a}:{b}:{docs}:{owners}:{'copied' if docs > 20 or (owners > 2 and docs > 3) else 'live'}")
        assert got[i].carriers == ",".join(want)
    assert got[0].n_copied == 2 and got[90].n_live == 3
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

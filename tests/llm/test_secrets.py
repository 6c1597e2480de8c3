import re

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphlake.llm.secrets import automaton, checksum, find_secrets, scan_secrets

AUTO = automaton()


def brute(text):
    """Plain expressions over the whole text, as the contract states them."""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([letters("password"), letters("passwd"), letters("secret"), letters("token"), letters("api") + "_?" + letters("key")])
    out = [("assign", *m.span()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "ApiKey", "passwd", "password", "AKIA", "=", ":", " ", '"', "0123456789abcdef", "ABCDEFGHIJKLMNOP", "x", "ſ", "İ", "\n", "ghp_", "=="]), max_size=14))
def test_base_spans_equal_plain_expressions(parts):
    text = "".join(parts)
    assert [x for x in find_secrets(text, AUTO) if x[0] != "checked"] == brute(text)


def test_embedded_checksum_decides():
    good = "ghp_" + "A1b2C3d4E5" * 3 + checksum("A1b2C3d4E5" * 3)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert find_secrets(f"x {good} y", AUTO) == [("checked", 2, 42)]
    assert find_secrets(f"x {bad} y", AUTO) == []


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "token = 0123456789abcdef", "c"), (3, "x" * 300_000, "d"), (3, "x" * 300_000, "d")]
    out = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == by[2].base_sha256
    assert by[None].n_assign == 1 and by[None].n_hex == 1 and by[None].spans == "assign:0:24,hex:8:24"
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string")).collect() == []

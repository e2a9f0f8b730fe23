"""Decisions of a fetch and of a package's paths."""

import pyarrow as pa
import pytest
from quillstone.sources import net


def test_robots():
    rules = "User-agent: *\nDisallow: /private\n"
    assert net.allowed(200, rules, "bot", "http://h/open") and not net.allowed(200, rules, "bot", "http://h/private/x")
    assert not net.allowed(503, "", "bot", "http://h/") and net.allowed(404, "", "bot", "http://h/") and not net.allowed(None, "", "bot", "http://h/")


def test_revalidation():
    first, changed = net.Kept().after(200, {"ETag": "a"}, b"x")
    assert changed and first.asked() == {"If-None-Match": "a"}
    same, changed = first.after(304, {}, b"")
    assert not changed and same.body == b"x" and same.etag == "a"
    with pytest.raises(ValueError):
        first.after(500, {}, b"")
    with pytest.raises(ValueError):
        first.after(200, {}, bytes(net.MOST_BYTES + 1))


def test_redirects():
    assert net.followed("http://a/1", {"http://a/1": "/2", "http://a/2": "http://b/"}) == "http://b/"
    for answers in ({"http://a/": "http://a/"}, {"http://a/": "file:///etc"}, {f"http://a/{'x' * k}": f"http://a/{'x' * (k + 1)}" for k in range(9)}):
        with pytest.raises(ValueError):
            net.followed("http://a/", answers)
    with pytest.raises(ValueError):
        net.followed("http://a/", {"http://a/": "http://10.0.0.1/"}, lambda h: not h.startswith("10."))


def test_confined(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text("a")
    (tmp_path / "d" / "out").symlink_to("/etc")
    assert net.confined(str(tmp_path), "d/x.csv") == str(tmp_path / "d" / "x.csv")
    for bad in ("", "/etc/passwd", "../x", "d/../../x", "http://h/x", ".hidden", "d\\x", "d/out/passwd", "~/x", "d//x"):
        assert net.confined(str(tmp_path), bad) is None, bad


def test_codecs_and_escapes():
    assert net.text_codec(None) == "utf-8-sig" and net.text_codec("UTF8") == "utf-8-sig" and net.text_codec("cp949") == "cp949"
    for bad in ("zlib", "hex", "no-such"):
        with pytest.raises(ValueError):
            net.text_codec(bad)
    assert net.unescaped(r"aé😀") == "aé\U0001f600" and net.unescaped(r"\U0001f600") == "\U0001f600" and net.unescaped(r"\ud800") == r"\ud800"


def test_message_costs():
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("n", pa.int64())])) as w:
        w.write_batch(pa.record_batch([pa.array(range(100))], ["n"]))
        w.write_batch(pa.record_batch([pa.array(range(10))], ["n"]))
    data = out.getvalue().to_pybytes()
    costs = net.message_costs(data)
    assert costs[0] == 0 and costs[1] >= 800 and 80 <= costs[2] < 800 and net.message_costs(data[: len(data) // 2])[:2] in ([0], [0, costs[1]])

"""Output, plug-ins and the command line."""

import json

import pytest
from quillstone import output, plugins
from quillstone.__main__ import capabilities, main
from quillstone.reader import Options, read
from quillstone.sources.parsers import Parsed


def shout(name, data):
    out = Parsed("shout")
    out.add(data.decode().upper())
    return out


def starts_bang(name, head):
    return head.startswith(b"!")


def is_secret(name, data):
    return data.startswith(b"SECRET")


def lines_of(data):
    return [(t, None) for t in data.decode().splitlines()]


def broken(data):
    raise RuntimeError("no model")


def test_widths_and_tables():
    assert output.width("a가é") == 4 and output.fitted("가" * 50) == "가" * 38 + "..." and output.fitted({"a": "é"}) == '{"a": "é"}'
    text = output.table([{"a": 1}, {"a": 22, "b": "가"}, {"b": "x"}], 2)
    assert text.splitlines() == ["a   b", "--  --", "1", "22  가", "... 1 more rows"]
    assert output.table([]) == "(no rows)" and output.compact({"a": None, "b": [], "c": {"d": None}, "e": 0}) == {"e": 0}


def test_registry(spark, tmp_path):
    (tmp_path / "a.zzz").write_text("hello")
    (tmp_path / "b").write_text("!bang")
    (tmp_path / "c.txt").write_text("SECRET x")
    r = plugins.Registry()
    r.suffix(f"{__name__}:shout", ".ZZZ")
    r.rule(f"{__name__}:starts_bang", f"{__name__}:shout")
    r.seal(f"{__name__}:is_secret")
    assert r.pick("A.zzz", b"", False)("a", b"x").blocks[0][1] == "X" and r.pick("b", b"!x", True) is None and r.pick("b", b"!x", False) is not None
    assert r.locked("c.txt", b"SECRET") and not r.locked("c.txt", b"x")
    with pytest.raises(AttributeError):
        plugins.resolved("json:nothing")


def test_readers(spark, tmp_path):
    rs = [plugins.Reader("cloud", "paid", "x:y"), plugins.Reader("own", "served", "x:y"), plugins.Reader("a", "local", "x:y")]
    assert [r.name for r in plugins.chosen(rs)] == ["a", "own"] and [r.name for r in plugins.chosen(rs, ["cloud", "a"])] == ["cloud", "a"]
    with pytest.raises(ValueError):
        plugins.chosen(rs, ["b"])
    assert rs[0].identity(lang="ko") != rs[0].identity(lang="en")
    (tmp_path / "x.txt").write_text("one\n\ntwo 2\n")
    assert [tuple(r) for r in plugins.external_readings(spark, f"mine={tmp_path}/x.txt").collect()] == [("mine", 0, "one", None), ("mine", 2, "two 2", None)]
    with pytest.raises(ValueError):
        plugins.external_readings(spark, "mine")


def test_members_and_password(spark, tmp_path):
    m = spark.createDataFrame([("p", "a/b c.txt", bytearray(b"1")), ("q", "B C.txt", bytearray(b"2")), ("q", "x", None)], "path string, name string, content binary")
    rows = output.write_members(m, str(tmp_path / "m")).collect()
    assert len({r.file for r in rows}) == 3 and sorted(open(r.file).read() for r in rows) == ["", "1", "2"]
    (tmp_path / "pw").write_text("first\nsecond")
    assert output.password("given", str(tmp_path / "pw")) == "first" and output.password("given") == "given" and output.password(variable="QUILLSTONE_NONE") is None
    output.append_lines(spark.range(2), str(tmp_path / "j"))
    output.append_lines(spark.range(1), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("hello\n")
    (tmp_path / "b.json").write_text("{broken")
    assert main(["read", str(tmp_path / "a.txt"), "--json", "--content"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["rows"][0]["content"] == [{"cite": f"{tmp_path}/a.txt:1", "text": "1| hello"}] and got["summary"]["complete"]
    assert main(["read", str(tmp_path), "--limit", "1", "--out", str(tmp_path / "o")], spark) == 1
    assert "1 more rows" in capsys.readouterr().out and (tmp_path / "o" / "index.jsonl").read_text().count("\n") == 2
    assert main(["read", str(tmp_path / "none")], spark) == 3 and main(["what"], spark) == 2
    capsys.readouterr()
    assert main(["doctor", "--json"]) == 0 and any(r["name"] == "pyspark" and r["found"] for r in capabilities())


def test_read_pictures(spark):
    items = spark.createDataFrame([(1, bytearray(b"a\nb"))], "item int, content binary")
    rs = [plugins.Reader("l", "local", f"{__name__}:lines_of"), plugins.Reader("z", "local", f"{__name__}:broken")]
    frames = plugins.read_pictures(items, rs)
    assert frames.columns == ["item", "engine", "box_no", "text", "bbox", "error"]
    run = read(spark, __file__, options=Options(suffixes=(".py",)))
    assert run.items.count() == 1
    run.close()


def test_missing_uri(spark, tmp_path, capsys):
    assert main(["read", f"file://{tmp_path}/gone"], spark) == output.MISSING
    (tmp_path / "a.txt").write_text("one")
    assert main(["read", f"file://{tmp_path}", "--json"], spark) == output.OK and "a.txt" in capsys.readouterr().out

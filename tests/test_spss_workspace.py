import struct

import pytest

from quarry import PlanError
from quarry.explore import workspace
from quarry.explore.drafts import FilterDraft, QueryDraft
from quarry.sources import spss
from quarry.sources.tables import open_table

CASES = [(1.0, "alpha", "a long text of more than eight"), (None, "", "x"), (2.5, "ünï", "y"), (-7.0, "beta", "")]


def number(order, *values):
    return b"".join(struct.pack(order + "i", v) for v in values)


def write(path, order="<", compressed=False):
    """A system file with one number and two texts (8 and 30 bytes), long names and value labels."""
    out = b"$FL2" + b"@(#) test".ljust(60) + number(order, 2, 6, int(compressed), 0, len(CASES)) + struct.pack(order + "d", 100.0) + b" " * 84
    variable = lambda width, name: number(order, 2, width, 0, 0, 0, 0) + name.ljust(8)
    out += variable(0, b"NUM") + variable(8, b"SHORT") + variable(30, b"LONG") + 3 * variable(-1, b"")
    out += number(order, 3, 1) + struct.pack(order + "d", 1.0) + bytes([3]) + b"one".ljust(7) + number(order, 4, 1, 1)
    names = b"NUM=number_of_things\tLONG=long_text"
    out += number(order, 7, 13, 1, len(names)) + names + number(order, 7, 20, 1, 5) + b"UTF-8" + number(order, 999, 0)
    if not compressed:
        for n, a, b in CASES:
            out += struct.pack(order + "d", spss.MISSING if n is None else n) + a.encode().ljust(8) + b.encode().ljust(32)
    else:
        codes, raw, body = [], b"", b""
        for n, a, b in CASES:
            units = [n, *(a.encode().ljust(8)[i : i + 8] for i in (0,)), *(b.encode().ljust(32)[i : i + 8] for i in range(0, 32, 8))]
            for unit in units:
                if unit is None:
                    codes.append((255, b""))
                elif unit == b" " * 8:
                    codes.append((254, b""))
                elif isinstance(unit, float) and unit == int(unit) and 1 <= unit + 100 <= 251:
                    codes.append((int(unit) + 100, b""))
                else:
                    codes.append((253, struct.pack(order + "d", unit) if isinstance(unit, float) else unit))
        codes.append((252, b""))
        for at in range(0, len(codes), 8):
            part = codes[at : at + 8]
            body += bytes(c for c, _ in part).ljust(8, b"\0") + b"".join(r for _, r in part)
        out += raw + body
    path.write_bytes(out)


@pytest.mark.parametrize("compressed", [False, True])
@pytest.mark.parametrize("order", ["<", ">"])
def test_system_file(spark, tmp_path, order, compressed):
    path = tmp_path / "t.sav"
    write(path, order, compressed)
    table = open_table(spark, str(path))
    assert table.df.dtypes == [("number_of_things", "double"), ("SHORT", "string"), ("long_text", "string")]
    assert sorted(map(tuple, table.df.collect()), key=repr) == sorted(CASES, key=repr)
    assert spss.value_labels(str(path)) == {"number_of_things": {1.0: "one"}}


def test_other_files_are_rejected(tmp_path):
    path = tmp_path / "t.sav"
    for content in (b"$FL3" + b" " * 200, b"nothing"):
        path.write_bytes(content)
        with pytest.raises(ValueError):
            spss.read_header(str(path))
    with pytest.raises(FileNotFoundError):
        spss._files(str(tmp_path / "none" / "x.sav"))


def test_workspace_round_trip():
    draft = QueryDraft("aggregate", "a&b", "name", (FilterDraft("n", ">", "3, é"), FilterDraft("s", "contains", "=x")), ("k", "l"), "v", ("a",), 7)
    assert workspace.decode("?" + workspace.encode("t", draft)) == ("t", draft)
    assert workspace.decode("") == ("", QueryDraft())
    for bad in ("mode=dance", "f=zz", "top=x", "f=[[1]]"):
        with pytest.raises(PlanError):
            workspace.decode(bad)


def test_history():
    history = workspace.History(0, depth=2)
    for state in (1, 1, 2, 3):
        history.push(state)
    assert [history.undo(), history.undo(), history.undo(), history.redo()] == [2, 1, 1, 2]
    history.push(9)
    assert history.redo() == 9

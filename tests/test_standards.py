import pytest

from tidewater.model import CatalogueError, MissingFileError, UnknownStandardError
from tidewater.sources.sample_standard import write_sample
from tidewater.sources.standards import conformance, load_standard, standard_path


@pytest.mark.parametrize("kind", ["SDTM", "send", "ADaM"])
def test_load(spark, tmp_path, kind):
    s = load_standard(spark, write_sample(str(tmp_path), kind))
    assert s.names() == ["LI", "NA"] and s.dataset("li").first()["label"] == "Line Items" and s.dataset("zz").isEmpty()
    rows = s.variables_of("na").collect()
    assert [(r["name"], r["type"]) for r in rows] == [("NKEY", "Num"), ("NNAME", "Char")]
    assert [r["order"] for r in rows] == ([6, 7] if kind == "ADaM" else [1, 0])
    assert s.variables_of("LI").where("name = 'COMMENT'").first()["role"] is None


def test_conformance(spark, tmp_path):
    s = load_standard(spark, write_sample(str(tmp_path)))
    df = spark.createDataFrame([(1.0, 2, "x")], "ORDKEY double, LINENO int, RETFLAG string")
    assert {tuple(r) for r in conformance(s, "LI", df).collect()} == {("RETFLAG", "Num", "Char", "type"), ("COMMENT", "Char", None, "missing")}


def test_path():
    assert standard_path("/x", "SDTM", "3.4") == "/x/sdtm/ig/v3.4"


def test_errors(spark, tmp_path):
    with pytest.raises(MissingFileError):
        load_standard(spark, str(tmp_path))
    folder = write_sample(str(tmp_path / "a"))
    (tmp_path / "a" / "metadata.toml").write_text('[standard]\npublishing_set = "OTHER"\n')
    with pytest.raises(UnknownStandardError):
        load_standard(spark, folder)
    (tmp_path / "a" / "metadata.toml").write_text("not toml")
    with pytest.raises(CatalogueError):
        load_standard(spark, folder)
    folder = write_sample(str(tmp_path / "b"))
    (tmp_path / "b" / "Variables.csv").unlink()
    with pytest.raises(MissingFileError):
        load_standard(spark, folder)

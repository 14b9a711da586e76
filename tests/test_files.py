import pytest

from veilspark.sources import files

NAMES = ["a.txt", "B.txt", "c {1},2.txt", "d[x]*.txt", "e-f!^.txt", "g\\h.txt", "ü +%.txt", "z.txt"]


@pytest.fixture
def folder(tmp_path):
    for n in NAMES:
        (tmp_path / n).write_text(f"text of {n}")
    (tmp_path / "no.bin").write_text("x")
    return str(tmp_path)


def opened(df):
    return len(df.inputFiles())


@pytest.mark.parametrize("name", NAMES)
def test_only_the_files_that_are_wanted_are_opened(spark, folder, name):
    got = files.list_files(spark, folder, [name, "missing.txt"])
    assert [(r.file_name, r.text) for r in files.extract(got).collect()] == [(name, f"text of {name}")] and opened(got) == 1


def test_the_first_files_by_name(spark, folder):
    got = files.list_files(spark, folder, most=3)
    assert opened(got) == 3 and sorted(r.file_name for r in got.collect()) == sorted(["a.txt", "B.txt", "c {1},2.txt"])
    some = files.list_files(spark, folder, ["z.txt", "a.txt", "B.txt"], most=2)
    assert opened(some) == 2 and sorted(r.file_name for r in some.collect()) == ["B.txt", "a.txt"]
    assert files.list_files(spark, folder).count() == len(NAMES) and files.list_files(spark, folder, []).count() == 0

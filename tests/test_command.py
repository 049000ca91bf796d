"""The command line, in the test's session."""

import os

import pytest

from readsieve.__main__ import main, parser

SAM = ["@HD\tVN:1.6", "@SQ\tSN:c1\tLN:1000", "@RG\tID:lane"] + [f"I:{k}:F:1:1:{500 * k}:1\t{f}\tc1\t{p}\t9\t4M\t=\t{q}\t0\tACGT\tIIII" for k in range(3) for f, p, q in ((99, 10, 50), (147, 50, 10))]


def test_marks_and_reports(spark, tmp_path):
    (tmp_path / "in.sam").write_text("\n".join(SAM) + "\n")
    at = lambda n: str(tmp_path / n)
    assert main(["--input", at("in.sam"), "--output", at("out.sam"), "--metrics", at("m.txt"), "--remove-duplicates", "--tag-duplicate-set-members"]) == 0
    text = "".join((tmp_path / "out.sam" / p).read_text() for p in sorted(os.listdir(tmp_path / "out.sam")) if p.startswith("part-")).splitlines()
    assert [x for x in text if x[0] != "@"] == [f"{x}\tDI:i:0\tDS:i:3\tPG:Z:readsieve" for x in SAM[3:5]] and text[3].startswith("@PG\tID:readsieve\t")
    lines = (tmp_path / "m.txt").read_text().splitlines()
    at_row = lines.index("## METRICS") + 2
    assert lines[at_row].split("\t") == ["lane", "0", "3", "0", "0", "0", "2", "0", str(2 / 3), "1"]
    assert lines[lines.index("## HISTOGRAM\tDouble") + 2].startswith("1\t0.9")


@pytest.mark.parametrize("arguments", [[], ["--create-index"], ["--tagging-policy", "Some"]])
def test_wrong_arguments(arguments, capsys):
    with pytest.raises(SystemExit):
        main(["--input", "a", "--output", "b", "--metrics", "c", *arguments] if arguments else [])
    assert "usage" in capsys.readouterr().err and parser().prog == "readsieve"

import json
import os
import tempfile

import pytest

from assay.sources import claims as cl
from assay.session import scratch_path
from assay.sources import fever as fv
from assay.sources import results as rs


def write(lines, name="part.txt", folder=None):
    folder = folder or tempfile.mkdtemp(prefix="assay-test-")
    with open(os.path.join(folder, name), "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")
    return folder


FULL = ["1.json", "true", "  A claim. ", "tax", "bob", "job", "NY", "dem", "1", "2", "3", "4", "5", "a speech"]


def line(**changes):
    row = dict(zip([*cl.RAW_STRINGS_FIRST, *cl.RAW_COUNTS, *cl.RAW_LAST], FULL))
    row.update(changes)
    return "\t".join(row.values())


def test_tsv_rows(spark):
    folder = write(
        [line(), line(id="short").rsplit("\t", 4)[0], line(id="long") + "\tsurplus", line(id="odd", label_str="unknown"),
         line(id="noclaim", claim=""), line(id="nobody", speaker="", subject=""), line(id="quote", claim='he said "no')],
        "train.tsv",
    )
    raw = {r.id: r for r in cl.scan_tsv(spark, folder + "/train.tsv").collect()}
    assert set(raw) == {"1.json", "short", "odd", "noclaim", "nobody", "quote"}
    assert raw["short"].context is None and raw["1.json"].pants_fire_counts == 5
    rows = {r.id: r for r in cl.clean(cl.scan_tsv(spark, folder + "/train.tsv")).collect()}
    assert set(rows) == {"1.json", "short", "nobody", "quote"}
    assert rows["1.json"].claim == "A claim." and rows["1.json"].label == 1
    assert rows["nobody"].speaker == "" and rows["nobody"].subject == ""


def test_all_six_labels(spark):
    folder = write([line(id=name, label_str=name) for name in cl.LABEL_CLASS], "test.tsv")
    got = {r.label_str: r.label for r in cl.load_split(spark, folder, "test").collect()}
    assert got == cl.LABEL_CLASS


def test_unknown_split(spark):
    with pytest.raises(ValueError):
        cl.load_split(spark, "/nowhere", "dev")


def test_speaker_history(spark):
    folder = write([line(), line(id="none").rsplit("\t", 6)[0]], "train.tsv")
    rows = {r.id: r for r in cl.speaker_history(cl.scan_tsv(spark, folder + "/train.tsv")).collect()}
    assert rows["1.json"].history_total == 15 and rows["1.json"].false_share == pytest.approx(2 / 15)
    assert rows["none"].history_total == 0 and rows["none"].half_true_share == 0.0


def test_keyed_claims(spark):
    rows = [
        {"claim": "a", "label": "SUPPORTS", "evidence": [[[1, 2, "P", 0]]]},
        {"claim": "b", "label": "NOT ENOUGH INFO", "evidence": [[[1, None, None, None]]]},
        {"claim": "c", "label": "REFUTES", "evidence": [[[1, 2, "P", 3], [1, 2, None, None]]]},
        {"claim": "d", "label": "REFUTES", "evidence": []},
    ]
    path = write([json.dumps(r) for r in rows])
    got = {r.claim: r for r in fv.load_claims(spark, path).collect()}
    assert {c: r.label for c, r in got.items()} == {"a": 1, "c": 0, "d": 0}
    assert got["a"].evidence == [[["1", "2", "P", "0"]]]
    # The cap counts input lines before the filter.
    assert sorted(r.claim for r in fv.load_claims(spark, path, max_lines=3).collect()) == ["a", "c"]


def test_sentence_table(spark):
    pages = [
        {"id": "T", "lines": "0\told page"},
        {"id": "U", "lines": "0\tfirst\n0\tsecond\tlink\nx\tbad\n1\t  \n2\nnothing\n3\t third "},
        {"id": "V"},
    ]
    folder = write([json.dumps(p) for p in pages], "wiki-001.jsonl")
    write([json.dumps({"id": "T", "lines": "1\tnew page"})], "wiki-002.jsonl", folder)
    got = sorted(map(tuple, fv.sentence_table(fv.scan_pages(spark, folder)).collect()))
    assert got == [("T", 1, "new page"), ("U", 0, "second"), ("U", 3, "third")]


def test_exports(spark):
    rows = spark.createDataFrame([("lr", 0.5, 0.25), ("net", 0.75, 0.5)], "model string, test_acc double, test_f1_macro double")
    flat = rs.summary(baseline=rows.where("model = 'lr'"), main=rows.where("model = 'net'"))
    assert sorted(map(tuple, flat.collect())) == [("lr", "baseline", "0.5000", "0.2500"), ("net", "main", "0.7500", "0.5000")]
    path = scratch_path(spark, "nested")
    rs.export_nested({"baselines": rows, "robustness": rows.select("model")}, path)
    row = spark.read.json(path).first()
    assert [r.model for r in row.baselines] == ["lr", "net"] and len(row.robustness) == 2 and row.timestamp
    path = scratch_path(spark, "report")
    rs.write_report(rows, path)
    assert spark.read.option("header", True).csv(path).count() == 2

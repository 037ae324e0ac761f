"""Run folders, sinks, manifests and resume checks on small folders."""

import json

import numpy as np
import pytest

from tallyloom.functions import conversion as cv
from tallyloom.sources import runs, sinks


@pytest.fixture
def run(tmp_path):
    """A run of three shards: one whole, one without verdicts, one with a first round."""
    verdicts = {"3": [{"sample_id": 0, "compiled": True, "correctness": True, "runtime": 2.0, "runtime_stats": {"min": 1.5}, "metadata": {"hardware": "H100"}}, {"sample_id": 1}], "10": [{"sample_id": 0, "compiled": True}]}
    root = tmp_path / "runs" / "m_level4"
    for shard in ("shard_00", "shard_01", "shard_02"):
        (root / shard / "traces").mkdir(parents=True)
        (root / shard / "traces" / "attempts.jsonl").write_text('{"stem": "a"}\n')
    (root / "shard_00" / "eval_results.json").write_text(json.dumps(verdicts))
    old = root / "shard_02" / "rounds" / "round_0"
    old.mkdir(parents=True)
    (old / "eval_results.json").write_text(json.dumps(verdicts))
    (root / "shard_02" / "traces" / "round_0").mkdir()
    (root / "shard_02" / "traces" / "round_0" / "attempts.jsonl").write_text('{"stem": "b"}\n')
    return root


def test_units_and_layout(spark, run, tmp_path):
    u = {r["shard"]: r for r in runs.units(spark, [str(run)]).collect()}
    assert [u[f"shard_0{i}"]["skipped"] for i in range(3)] == [None, "no_eval_results", None]
    assert u["shard_02"]["attempts"].endswith("shard_02/traces/round_0/attempts.jsonl") and u["shard_02"]["verdicts"].endswith("shard_02/rounds/round_0/eval_results.json")
    assert runs.units(spark, [str(run) + "/"], max_shards=1).count() == 1
    got = {r["run_name"]: r["folder"] for r in runs.expand_runs(spark, [str(run)], [4]).collect()}
    assert set(got) == {"m_level4__shard_00", "m_level4__shard_02"} and got["m_level4__shard_02"].endswith("rounds/round_0/")
    with pytest.raises(ValueError, match="duplicate run name"):
        runs.expand_runs(spark, [str(run), str(run)], [4, 4])
    with pytest.raises(ValueError, match="share a name"):
        runs.units(spark, [str(run), str(run)])
    with pytest.raises(FileNotFoundError, match="no shards"):
        runs.units(spark, [str(run / "shard_00")])
    assert runs.eval_run_name("/x/runs/a/runs/m/shard_07") == "m/shard_07" and runs.eval_run_name("/x/y") == "y" and runs.eval_run_name("/x/runs") == "runs"


def test_samples_and_settings(spark, run):
    shard = run / "shard_00"
    with pytest.raises(ValueError, match="level"):
        runs.load_run(spark, str(shard))
    sinks.write_config(spark, str(shard), {"level": 6, "model": "m/x", "num_samples": 8, "pseudo_level": 1}, converted=True)
    info = runs.load_run(spark, str(shard))
    assert info == {"run_name": "shard_00", "level": 6, "model": "m/x", "backend": None, "num_samples": 8}
    assert runs.load_run(spark, str(run))["level"] == 4
    s = runs.samples(spark, str(shard)).orderBy("problem_id", "sample_id").collect()
    assert [(r["problem_id"], r["sample_id"], r["compiled"], r["correct"], r["runtime_min"]) for r in s] == [(3, 0, True, True, 1.5), (3, 1, False, False, None), (10, 0, True, False, None)]
    assert s[2]["file"] == "level_6_problem_10_sample_0_kernel.py" and [r["problem_id"] for r in runs.samples(spark, str(shard), 2).collect()] == [3, 3]
    sinks.write_config(spark, str(shard), {"level": 2, "pseudo_level": 1, "greedy": True})
    assert runs.settings(spark, str(shard / "generation_config.yaml")) == {"greedy": "true", "level": "2"}


def test_kernels_are_written_once_and_listed_in_order(spark, tmp_path):
    rows = [(1, p, s, f"x = {p}") for p in (10, 2) for s in (11, 3)] + [(1, 5, 0, None)]
    df = spark.createDataFrame(rows, "level long, problem_id long, sample_id long, code string")
    folder = str(tmp_path / "out")
    assert sinks.write_kernels(df, folder) == 5
    got = runs.kernel_names(spark, folder).collect()
    assert [tuple(r)[1:3] for r in got] == [(2, 3), (2, 11), (5, 0), (10, 3), (10, 11)]
    assert (tmp_path / "out" / "level_1_problem_10_sample_3_kernel.py").read_text() == "x = 10" and runs.kernel_names(spark, folder, 2).count() == 2
    with pytest.raises(FileExistsError):
        sinks.write_kernels(df, folder)
    with pytest.raises(ValueError, match="duplicate kernel"):
        sinks.write_kernels(df.unionByName(df), str(tmp_path / "other"))


def test_problems(spark, tmp_path):
    (tmp_path / "7_Relu.py").write_text("a")
    (tmp_path / "12_Big.py").write_text("b" * 50)
    (tmp_path / "notes.json").write_text("{}")
    p = {r["problem_id"]: (r["name"], r["source"], r["fate"]) for r in runs.local_problems(spark, str(tmp_path), 6, "7,9,10-12", 20).collect()}
    assert p == {7: ("7_Relu.py", "a", "read"), 9: (None, None, "missing"), 10: (None, None, "missing"), 11: (None, None, "missing"), 12: ("12_Big.py", None, "too_long")}
    assert [r["problem_id"] for r in runs.load_problems(spark, root=str(tmp_path), level=6, max_chars=20).collect()] == [7]
    (tmp_path / "7_Again.py").write_text("c")
    with pytest.raises(ValueError, match="duplicate reference"):
        runs.references(spark, str(tmp_path))
    d = spark.createDataFrame([(0, "10_X.py", "s"), (1, None, "t"), (2, "Y.py", "u" * 9)], "index long, name string, code string")
    assert sorted(tuple(r)[1:3] for r in runs.indexed_problems(d, 1, "0-1").collect()) == [(1, "problem_0001.py"), (10, "10_X.py")]
    d.write.parquet(str(tmp_path / "set"))
    assert [r["problem_id"] for r in runs.load_problems(spark, dataset=str(tmp_path / "set"), spec="2").collect()] == [2]
    with pytest.raises(ValueError, match="folder or"):
        runs.load_problems(spark)


def test_eval_shards(spark, tmp_path):
    for name in ("c_s00", "c_s01", "c_smoke_s00"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.py").write_text("x")
    with pytest.raises(FileNotFoundError, match="not been evaluated"):
        runs.eval_shards(spark, str(tmp_path), "c")
    for i, name in enumerate(("c_s00", "c_s01", "c_smoke_s00")):
        (tmp_path / name / "eval_results.json").write_text(json.dumps({str(i % 2): [{"sample_id": 0}]}))
    assert sorted((r["folder"], r["problem_id"]) for r in runs.eval_shards(spark, str(tmp_path), "c").collect()) == [("c_s00", 0), ("c_s01", 1)]
    (tmp_path / "c_s01" / "eval_results.json").write_text(json.dumps({"0": [{"sample_id": 0}]}))
    with pytest.raises(ValueError, match="two shards"):
        runs.eval_shards(spark, str(tmp_path), "c")
    with pytest.raises(FileNotFoundError):
        runs.eval_shards(spark, str(tmp_path), "other")


def test_lists_findings_traces_and_side_tables(spark, tmp_path):
    assert runs.alternatives("a{x,y}b{1,2}") == ["axb1", "axb2", "ayb1", "ayb2"] and runs.alternatives("p") == ["p"]
    for split in ("train", "val"):
        (tmp_path / f"l_{split}.jsonl").write_text(json.dumps({"problem_id": 1, "candidates": [{"run_name": split, "sample_id": 4}]}) + "\n")
    assert runs.seen_by_scorer(spark, str(tmp_path / "l_{train,val}.jsonl")).count() == 2
    lines = [{"level": 1, "problem_id": 2, "sample_id": 3, "path": "old"}, {"level": 1, "problem_id": 2, "sample_id": 3, "path": "new"}, {"level": 1, "path": "none"}]
    (tmp_path / "f.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    assert [(r["sample_id"], r["path"]) for r in runs.findings(spark, str(tmp_path / "f.jsonl")).collect()] == [(3, "new")]
    np.savez(tmp_path / "s.npz", token_ids=np.array([5, 6]), topk_ids=np.array([[5, 1], [6, 2]]), topk_lp=np.array([[-0.1, -3.0], [-0.2, -np.inf]]), sampled_lp=np.array([-0.1, -0.2]), sampled_rank=np.array([1, 1]), seg=np.array([0, 1], np.int8), meta=np.array(json.dumps({"passes": 2})))
    (t,) = runs.traces(spark, str(tmp_path)).collect()
    assert t["stem"] == "s" and t["token_ids"] == [5, 6] and t["topk_lp"][1][1] == -np.inf and json.loads(t["meta"]) == {"passes": 2}
    (tmp_path / "p.json").write_text(json.dumps({"k": "be kind"}))
    rows = spark.createDataFrame([(1, "k")], "i int, system_prompt_sha1 string")
    assert runs.sources(rows, runs.prompts(spark, str(tmp_path / "p.json"))).first()["system_prompt"] == "be kind"
    with pytest.raises(ValueError, match="side table"):
        runs.sources(rows.selectExpr("i", "'z' AS system_prompt_sha1"), runs.prompts(spark, str(tmp_path / "p.json")))
    (tmp_path / "splits.json").write_text(json.dumps({"1:5": "val"}))
    assert [tuple(r) for r in runs.load_splits(spark, str(tmp_path / "splits.json")).collect()] == [(1, 5, "val")]


def test_parts_manifest_and_resume(spark, tmp_path):
    df = spark.range(3).selectExpr("id AS prefix_id", "id / 2 AS v")
    path = str(tmp_path / "part.jsonl")
    assert sinks.write_values(df, path) == 3 and spark.read.json(path).count() == 3 and not sinks.is_fresh(spark, path, "s")
    sinks.write_part(df, path, {"source_sha1": "s"})
    assert sinks.is_fresh(spark, path, "s") and not sinks.is_fresh(spark, path, "t") and not sinks.is_fresh(spark, path + "x", "s")
    assert sinks.write_part(df.limit(0), str(tmp_path / "none")) == 0 and not sinks.exists(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="duplicate value"):
        sinks.write_values(df.unionByName(df), path)
    records = {"b": {"schema_version": 2, "counts": {"rows": 3, "truncated": 1}, "dropped": {"truncated": ["x"]}}, "a": {"schema_version": 2, "counts": {"rows": 2, "cuts": 9}, "dropped": {}}}
    m = sinks.manifest(records, ["truncated", "too_long"], {"k": 1}, 1, [("r", "s", "no_attempts")], baseline_sha1="z")
    assert m["attempts"] == 6 and m["counts"] == {"rows": 5, "cuts": 9, "truncated": 1} and m["units_reused"] == 1 and m["dropped_stems"] == {"truncated": ["x"]} and list(m["units"]) == ["a", "b"]
    sinks.check_schema(records, 2, "here")
    sinks.check_resume(m, {"k": 1}, {"baseline_sha1": "z"}, "here")
    for was, knobs, shas in (({}, {}, {}), (m, {"k": 2}, {}), (m, {"k": 1}, {"baseline_sha1": "y"})):
        with pytest.raises(ValueError, match="here holds parts"):
            sinks.check_resume(was, knobs, shas, "here")
    with pytest.raises(ValueError, match="row schema 2"):
        sinks.check_schema(records, 3, "here")
    sinks.write_atomic(spark, str(tmp_path / "t.txt"), "one")
    sinks.write_atomic(spark, str(tmp_path / "t.txt"), "two")
    assert sinks.read_text(spark, str(tmp_path / "t.txt")) == "two" and sinks.read_text(spark, str(tmp_path / "no")) is None
    rows = spark.createDataFrame([("r", "s", "a", None), ("r", "s", "b", "truncated"), ("r", "s", "c", "truncated")], "run_name string, shard string, stem string, drop_reason string")
    assert sorted((r["reason"], r["n"], tuple(r["stems"])) for r in sinks.unit_ledger(rows).collect()) == [("rows", 1, ()), ("truncated", 2, ("b", "c"))]


def test_journal_is_pruned(spark, tmp_path):
    j = tmp_path / "attempts.jsonl"
    j.write_text("".join(json.dumps({"stem": s, "n": i}) + "\n" for i, s in enumerate("abca")))
    assert sinks.prune_journal(spark, str(j), ["a", "z"]) == 2 and [json.loads(x)["stem"] for x in j.read_text().splitlines()] == ["b", "c"]
    assert sinks.prune_journal(spark, str(j), ["q"]) == 0
    (tmp_path / "slots.jsonl").write_text('{"problem_id": 1, "sample_id": 2}\n{"problem_id": 1, "sample_id": 2}\n')
    assert [tuple(r) for r in runs.done_slots(spark, str(tmp_path / "slots.jsonl")).collect()] == [(1, 2)]
    with pytest.raises(ValueError, match="other settings"):
        runs.check_regime({"temperature": 0.6}, {"temperature": "1.0"}, "run")
    runs.check_regime({"model": "m"}, {"model": "m"}, "run")


def test_traces_and_search_results_are_written(spark, tmp_path):
    schema = "stem string, token_ids array<long>, topk_ids array<array<long>>, topk_lp array<array<double>>, sampled_lp array<double>, sampled_rank array<long>, seg array<int>, meta string"
    rows = [("a", [5, 6], [[5, 1], [6, 2]], [[-0.1, -3.0], [-0.2, -9.0]], [-0.1, -0.2], [1, 1], [0, 1], '{"passes": 2}'), ("b", None, None, None, None, None, None, None)]
    assert sinks.write_traces(spark.createDataFrame(rows, schema), str(tmp_path / "traces")) == 1
    (t,) = runs.traces(spark, str(tmp_path / "traces")).collect()
    assert tuple(t) == rows[0]
    pool = spark.createDataFrame([(1, 2, 0, "c0", "x"), (1, 2, 1, "c1", "y"), (1, 3, None, "c2", None)], "level long, problem_id long, sample_id int, cid string, code string")
    got = sinks.write_search(pool, spark.createDataFrame([(1, 2, "c1")], "level long, problem_id long, cid string"), str(tmp_path / "out"))
    assert got == {"n_pool": 2, "n_best": 1, "n_problems": 2, "n_no_code": 1}
    assert (tmp_path / "out" / "best" / "level_1_problem_2_sample_0_kernel.py").read_text() == "y" and spark.read.json(str(tmp_path / "out" / "texts")).count() == 3


ROW = """import torch
class Net(torch.nn.Module):
    def __init__(self, d, h=2, *, flag=None):
        super().__init__()
def get_inputs():
    return [torch.rand([4, 4, 4, 4]), torch.rand(4, 3), torch.full((4,), 4)]
def get_init_inputs():
    return [[4], {'h': 7}]
"""


def test_rows_are_converted_without_running_them():
    out = cv.converted(ROW, "Net", cv.Scale())
    assert "Model = Net" in out and out.endswith("    return [48, 7]\n")
    assert "torch.rand([48, 48, 48, 48]), torch.rand(48, 3), torch.full((48,), 4)" in out
    assert cv.converted(ROW, "Net").endswith("return [4, 7]\n") and "rand([4, 4, 4, 4])" in cv.converted(ROW, "Net")
    batch = cv.converted(ROW, "Net", cv.Scale(mode="batch-only"))
    assert "rand([2048, 4, 4, 4])" in batch and batch.endswith("return [4, 7]\n")
    assert cv.Scale(factor=0.5).target(2) == 1024 and cv.Scale().target(9) == 16 and cv.Scale(factor=0.01).target(5) == 4
    bad = [("Net", ROW.replace("[[4], {'h': 7}]", "[[torch.ones(4)], {}]")), ("Other", ROW), ("Net", ROW.replace("get_inputs", "inputs")), ("a b", ROW), ("Net", ROW.replace("{'h': 7}", "{'flag': 7}")), ("Net", ROW.replace("[4], {", "[], {")), ("Net", "x = (")]
    for name, source in bad:
        with pytest.raises(cv.ConversionError):
            cv.converted(source, name)


def test_paths_without_a_scheme_mean_one_place(spark, tmp_path):
    """What executors write lies where ``exists`` looks, under a plain path as under a qualified one."""
    rows = spark.createDataFrame([(1, 2, 0, "x = 1"), (1, 3, 0, "y = 2")], "level long, problem_id long, sample_id long, code string")
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/full"):
        assert sinks.write_kernels(rows, folder) == 2 and sinks.is_complete(spark, folder) and sinks.exists(spark, f"{folder}/level_1_problem_2_sample_0_kernel.py")
    assert sinks.qualified(spark, str(tmp_path / "plain")).startswith("file:/")
    assert sorted(p.name for p in (tmp_path / "plain").iterdir() if p.suffix == ".py") == sorted(p.name for p in (tmp_path / "full").iterdir() if p.suffix == ".py")
    (tmp_path / "held").mkdir()
    (tmp_path / "held" / "generation_config.yaml").write_text("level: 1\n")
    assert sinks.write_kernels(rows, str(tmp_path / "held")) == 2 and (tmp_path / "held" / "generation_config.yaml").exists()


def test_a_killed_writer_leaves_the_old_state(spark, tmp_path):
    """A task that fails for good leaves no file in place and no marker; the next writer clears what is left and makes all files."""
    rows = spark.createDataFrame([(1, p, 0, "x") for p in range(20)], "level long, problem_id long, sample_id long, code string").repartition(4)
    folder, good = str(tmp_path / "out"), rows.selectExpr("concat('f', problem_id) AS name", "code")
    with pytest.raises(Exception, match="killed"):
        sinks._put_files(good, folder, "name", lambda r: (_ for _ in ()).throw(RuntimeError("killed")) if r.name == "f7" else b"x")
    assert not sinks.exists(spark, folder) and not sinks.is_complete(spark, folder)
    assert any(p.name.startswith(".attempt-out-") for p in tmp_path.iterdir())
    assert sinks._put_files(good, folder, "name", lambda r: r.name.encode()) == 20 and sinks.is_complete(spark, folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0] == "f") == sorted(f"f{i}" for i in range(20)) and (tmp_path / "out" / "f7").read_text() == "f7"
    assert not any(p.name.startswith(".attempt") for p in tmp_path.iterdir())


def test_journal_is_last_and_whole(spark, tmp_path):
    """Kernels, traces, journal; a journal that cannot be written leaves the old one, and a large one goes the same way as a small one."""
    kernels = spark.createDataFrame([(1, 2, 0, "x = 1")], "level long, problem_id long, sample_id long, code string")
    journal = spark.createDataFrame([("a", 1), ("b", 2)], "stem string, n int")
    out = str(tmp_path / "gen")
    assert sinks.write_outputs(kernels, None, journal, out) == {"kernels": 1, "traces": 0, "records": 2}
    with pytest.raises(FileExistsError):
        sinks.write_outputs(kernels, None, journal, out)
    path = f"{out}/journal.jsonl"
    assert [json.loads(x) for x in (tmp_path / "gen" / "journal.jsonl").read_text().splitlines()] == [{"stem": "a", "n": 1}, {"stem": "b", "n": 2}]
    broken = journal.selectExpr("raise_error('no disk') AS stem", "n")
    with pytest.raises(Exception, match="no disk"):
        sinks.append_journal(broken, path)
    assert spark.read.json(path).count() == 2
    assert sinks.append_journal(spark.range(150_000).selectExpr("concat('s', id) AS stem", "0 AS n"), path) == 150_000
    assert sinks.prune_journal(spark, path, spark.range(100_000).selectExpr("concat('s', id) AS stem")) == 100_000 and spark.read.json(path).count() == 50_002
    assert sinks.prune_journal(spark, path, [f"s{i}" for i in range(100_000, 150_000)] + ["a", "b"]) == 50_002 and (tmp_path / "gen" / "journal.jsonl").read_text() == ""
    assert [p.name for p in (tmp_path / "gen").iterdir() if p.name.startswith(".journal") and not p.name.endswith(".crc")] == []

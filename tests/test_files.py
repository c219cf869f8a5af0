import json

import pytest
from pyspark.sql import types as T

from evidara.plans import answering
from evidara.sources import config, files
from evidara.streaming import response_log


def test_csv_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿Question,Answer,Category\n"a\nb",x,c\n"q ""1""",y,d\n', encoding="utf-8")
    df = files.with_record_numbers(files.read_csv(spark, str(tmp_path / "c.csv"), files.RAW_CORPUS))
    assert [tuple(r) for r in df.collect()] == [("a\nb", "x", "c", 2), ('q "1"', "y", "d", 3)]
    with pytest.raises(ValueError, match="Other"):
        files.read_csv(spark, str(tmp_path / "c.csv"), T.StructType().add("Other", "string"))


def test_jsonl_lenient_and_strict(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"score": 0.5, "label": 1}\n\nnot json\n{"score": 0.25, "label": 0}\n')
    good, bad = files.read_jsonl(spark, str(p), files.RELIABILITY)
    assert {tuple(r) for r in good.collect()} == {(0.5, 1), (0.25, 0)}
    assert [r[0] for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), files.RELIABILITY, strict=True)[0].collect()
    p.write_text('{"score": 1.5, "label": 1}\n')
    with pytest.raises(Exception, match="outside"):
        files.read_reliability(spark, str(p)).collect()


def test_optional_dictionary_manifest_and_guard(spark, tmp_path):
    assert files.read_dictionary(spark, str(tmp_path / "none.csv"), "Category", "English").count() == 0
    (tmp_path / "m.json").write_text(json.dumps({"graph_version": "v1", "counts": {"entities": 2}}))
    files.check_manifest(spark, str(tmp_path / "m.json"), "v1", {"entities": 2})
    with pytest.raises(ValueError):
        files.check_manifest(spark, str(tmp_path / "m.json"), "v1", {"entities": 3})
    df = spark.range(3)
    files.write_table(df, str(tmp_path / "t"), ["id"])
    with pytest.raises(Exception):
        files.write_table(df, str(tmp_path / "t"), ["id"])
    for n in (5, 7, 9):
        files.replace_table(spark.range(n), str(tmp_path / "state"))
        assert files.read_table(spark, str(tmp_path / "state")).count() == n
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("state-")]) == 2  # the state before stays for its readers
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, str(tmp_path / "nothing"))
    files.write_metadata(spark, str(tmp_path / "meta.json"), {"corpus_version": "v1"})
    files.write_metadata(spark, str(tmp_path / "meta.json"), {"corpus_version": "v2"})
    assert files.read_metadata(spark, str(tmp_path / "meta.json")) == {"corpus_version": "v2"}
    (tmp_path / "raw").write_text("a = 1\nb=x\n")
    assert files.read_metadata(spark, str(tmp_path / "raw")) == {"a": "1", "b": "x"}
    counts = files.snapshot_counts({"entities": df, "none": df.limit(0)})
    assert counts == {"entities": 3, "none": 0}
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "lines"), ["b", "a"])
    assert spark.read.text(str(tmp_path / "lines")).first()[0] == '{"b":null,"a":1}'
    assert files.health(spark) == {"ok": True, "version": spark.version}
    files.write_report(spark, str(tmp_path / "r.json"), {"n": 1})
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1}
    assert "Range" in files.dry_run({"a": df})["a"]


def test_settings():
    text = "# c\nEVIDARA_RETRIEVAL_QA_TOP_K=7\n\n  EVIDARA_CORPUS_ENABLED = 'no'  \nEVIDARA_RETRIEVAL_MAX_HOPS=x\nno assignment\n#EVIDARA_GRAPH_VERSION=z\nEVIDARA_GRAPH_PATH=a=b\n"
    assert config.parse_env_text(text) == {"EVIDARA_RETRIEVAL_QA_TOP_K": "7", "EVIDARA_CORPUS_ENABLED": "no", "EVIDARA_RETRIEVAL_MAX_HOPS": "x", "EVIDARA_GRAPH_PATH": "a=b"}
    s = config.load_settings({"EVIDARA_RETRIEVAL_QA_TOP_K": "9"}, env_text=text)
    assert (s.retrieval.qa_top_k, s.corpus.enabled, s.retrieval.max_hops, s.graph.path, s.graph_version) == (9, False, 1, "a=b", "v1")
    assert config.safe_tag(" a b/c ") == "a_b_c" and config.safe_tag("") == "run"
    with pytest.raises(ValueError):
        config.safe_index_name("a b")


def test_stream_takes_each_line_once(spark, tmp_path):
    src, state, ckpt = tmp_path / "src", tmp_path / "state", tmp_path / "ckpt"
    src.mkdir()
    line = lambda i, n, s: json.dumps({"request_id": i, "ordinal": n, "status": s, "response_text": "t"})
    (src / "1.json").write_text(line("a", 1, "error") + "\n" + line("b", 2, "ok") + "\n")
    response_log.follow(spark, str(src), str(state), str(ckpt)).awaitTermination(60)
    (src / "2.json").write_text(line("a", 3, "ok") + "\n")
    response_log.follow(spark, str(src), str(state), str(ckpt)).awaitTermination(60)
    now = response_log.current(spark, str(state))
    assert {(r["request_id"], r["ordinal"], r["status"]) for r in now.collect()} == {("a", 3, "ok"), ("b", 2, "ok")}
    asked = spark.createDataFrame([("a",), ("c",)], "request_id string")
    assert [r[0] for r in response_log.pending(asked, now).collect()] == ["c"]


def test_provider_failures_stay_with_their_row():
    def provider(prompts):
        if prompts[0] == "bad":
            raise RuntimeError("no")
        return ["{}" for _ in prompts]

    waits = []
    assert answering.with_retries(provider, 2, sleep=waits.append)(["a", "bad"]) == ["{}", json.dumps({"error": "RuntimeError: no", "attempts": 1})] and waits == []
    assert [answering.retry_wait(n) for n in (1, 2, 3, 9)] == [2.0, 4.0, 8.0, 30.0] and answering.retry_wait(1, 5.0) == 5.0 and answering.retry_wait(1, 99.0) == 30.0
    calls = []

    def limited(prompts):
        calls.append(prompts[0])
        raise answering.status_error(429 if prompts[0] == "later" else 401, "no  more\ncalls", {"Retry-After": "3", "Authorization": "secret"})

    waits = []
    replies = [json.loads(r) for r in answering.with_retries(limited, 3, sleep=waits.append)(["later", "never"])]
    assert calls == ["later"] * 3 + ["never"] and waits == [3.0, 4.0] and [r["attempts"] for r in replies] == [3, 1]
    assert replies[0]["error"] == "ProviderError: HTTP 429; retry-after=3; body=no more calls" and "secret" not in json.dumps(replies)


def test_payload_validation(spark):
    ok = json.dumps({"claims": [{"claim": "rest lowers fever", "citations": ["E1"]}, {"claim": "short", "citations": ["E1"]}], "limitations": []})
    other = json.dumps({"claims": [{"claim": "rest lowers fever", "citations": ["E9"]}] * 3})
    rows = [(1, f"```json\n{ok}\n```", ["E1"]), (2, "nothing", ["E1"]), (3, other, ["E1"]), (4, json.dumps({"error": "late"}), ["E1"])]
    got = answering.validated_claims(spark.createDataFrame(rows, "query_id int, reply string, allowed array<string>")).collect()
    assert {(r["query_id"], r["claim"], r["error"]) for r in got} == {(1, "rest lowers fever", None), (2, None, "not JSON"), (3, None, "too many claims"), (4, None, "late")}


def test_dictionary_keeps_the_last_value_of_the_file(spark, tmp_path):
    for part in range(3):  # later files come later
        lines = [f"k{i},v{part}-{i}" for i in range(40)] + [f"k0,last{part}"]
        (tmp_path / f"part-{part}.csv").write_text("a,b\n" + "\n".join(lines) + "\n")
        (tmp_path / f"one-{part}.csv").write_text("a,b\n" + "\n".join(lines * 2) + "\nk1,\n")
        got = {r["a"]: r["b"] for r in files.read_dictionary(spark, str(tmp_path / f"one-{part}.csv"), "a", "b").repartition(5).collect()}
        assert got["k0"] == f"last{part}" and got["k1"] == f"v{part}-1" and len(got) == 40

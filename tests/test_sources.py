"""Readers and writers on small files."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from dialogmill.sources import files, jsonl, schemas, sessions

SESSION = {"schemaVersion": "session.v1", "id": "s1", "startedAtMs": 1, "transcripts": [{"id": "t1", "speaker": "remote", "text": "Why|so?", "emittedMs": 5}, {"id": "t1", "speaker": "remote", "text": "How so?", "emittedMs": 6}], "assists": [{"id": "a", "transcriptId": "t1", "answerEn": "Because.", "state": "final"}, {"id": "b", "transcriptId": "t9", "answerEn": "x", "state": "partial"}]}


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('﻿{"term": "a"}\n[1]\nnot json\n\n{"term": "b", "tags": ["t"]}\n', encoding="utf-8")
    rows = jsonl.read_jsonl(spark, str(p), schemas.GLOSSARY)
    assert sorted(r["term"] for r in rows.collect()) == ["a", "b"]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.GLOSSARY).count() == 0
    assert jsonl.non_blank_lines(spark, str(p)) == 4
    jsonl.write_jsonl(rows, str(tmp_path / "out"))
    assert jsonl.read_jsonl(spark, str(tmp_path / "out"), schemas.GLOSSARY).count() == 2


def test_sessions(spark, tmp_path):
    (tmp_path / "s1.json").write_text(json.dumps(SESSION, indent=1))
    (tmp_path / "bad.json").write_text("{")
    got = sessions.read_sessions(spark, str(tmp_path)).cache()
    assert [r["file"] for r in got.collect()] == ["s1.json"]
    assert [(r["question"], r["answer"]) for r in sessions.assist_questions(got).collect()] == [("How so?", "Because.")]
    assert "Why\\|so?" in sessions.markdown(got).first()["body"]
    assert sessions.session_candidates(got).count() == 0  # one sentence after all
    store = str(tmp_path / "store")
    sessions.save_sessions(got, store)
    sessions.save_sessions(got.withColumn("id", F.lit("s2")), store)
    assert [r["id"] for r in sessions.load_sessions(spark, store, ["s2"]).collect()] == ["s2"] and sessions.load_sessions(spark, store).count() == 2
    assert [r["file"] for r in sessions.broken_sessions(spark, str(tmp_path / "*.json")).collect()] == ["bad.json"]
    assert json.loads(sessions.export_json(got).first()["body"])["id"] == "s1"
    assert sessions.normalized(got).first()["assists"][0]["reviewLabel"] == "unreviewed"


def test_snapshots_drop_empty_sessions_and_partial_assists(spark):
    heard = spark.createDataFrame([("a", 1, "hi")], "session_id string, ord int, text string")
    said = spark.createDataFrame([("a", 2, "t", "x", None, "partial"), ("a", 3, "t", "y", "k", "final"), ("a", 4, "t", "z", None, "final"), ("b", 1, "u", "w", None, "partial")], "session_id string, ord int, transcriptId string, answerEn string, error string, state string")
    ids = spark.createDataFrame([("a", 1), ("b", 2)], "id string, startedAtMs long")
    (row,) = sessions.snapshots(heard, said, ids).collect()
    assert row["id"] == "a" and [(x["answerEn"], x["error"]) for x in row["assists"]] == [("z", "k")] and len(row["transcripts"]) == 1


def test_worker_protocol_and_token_streams(spark):
    lines = spark.createDataFrame([('{"type": "transcript", "text": "hi", "tEndMs": 4}',), ("noise",)], "value string")
    row = sessions.worker_messages(lines).first()
    assert (row["speaker"], row["emittedMs"], row["confidence"]) == ("remote", 4, 0.0)
    chat = spark.createDataFrame([("a", 0, 10, 'data: {"choices": [{"delta": {"content": "He"}}]}'), ("a", 1, 20, 'data: {"choices": [{"delta": {"content": "y"}}]}'), ("a", 2, 30, "data: [DONE]"), ("b", 0, 5, '{"message": {"content": "Yo"}}')], "stream_id string, pos int, ms long, value string")
    assert {(r["stream_id"], r["text"], r["first_ms"]) for r in sessions.token_stream(chat).collect()} == {("a", "Hey", 10), ("b", "Yo", 5)}


def test_files(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t> One </w:t></w:p><w:p><w:t> </w:t></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.txt").write_bytes("Grüße\n\n\n\nx".encode("cp1254"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.md").write_bytes(b" a\r\n\r\n\r\n\r\nb\r\n")
    got = {r["path"].rsplit("/", 1)[-1]: (r["parser"], r["text"]) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("docx", "One\nTwo"), "b.txt": ("text", "Grüße\n\nx"), "c.pdf": (None, None), "d.md": ("text", "a\n\nb")}
    assert {r["text"] for r in files.read_texts(spark, str(tmp_path), 3).where("truncated").collect()} == {"One", "Grü", "a\n\n"}
    assert spark.createDataFrame([("é",), (None,)], "x string").select(files.unicode_form(F.col("x")).alias("y")).first()["y"] == "\xe9"


def test_profile_sources(spark):
    corpus = spark.createDataFrame([(i, "T" * 200, "x" * (119 + i)) for i in range(3)], "ord long, title string, text string")
    assert [len(r["name"]) for r in sessions.corpus_sources(corpus, 1).collect()] == [140]
    terms = spark.createDataFrame([("cache", "A fast store", None), ("x", "", "")], "term string, definition_en string, definition_tr string")
    assert [r["name"] for r in sessions.glossary_sources(terms).collect()] == ["GLOSSARY cache"]
    repos = spark.createDataFrame([("A", False, 0), ("b", True, 1), ("c", None, 2)], "name string, fork boolean, ord int")
    assert [r["name"] for r in sessions.repositories(repos, ["a", "C"]).collect()] == ["A", "c"]


def test_cache(spark):
    import hashlib

    rows = spark.createDataFrame([("x",), ("y",)], "text string")
    hit = spark.createDataFrame([(hashlib.sha1(b"x").hexdigest(), "v")], "key string, value string")
    assert {(r["text"], r["cached"]) for r in jsonl.cached(rows, hit, "text").collect()} == {("x", "v"), ("y", None)}
    saved = jsonl.save_misses(rows.withColumn("found", F.lit("w")), hit, "text", "found")
    assert sorted(r["value"] for r in saved.collect()) == ["v", "w"] and saved.count() == 2
    assert jsonl.load_config('{"a": 1}') == {"a": 1} and jsonl.load_config("a: 1") == {"a": 1}

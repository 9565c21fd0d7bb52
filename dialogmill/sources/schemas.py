"""Record schemas, as DDL. All fields are nullable; readers treat null, empty and zero alike."""

TRANSCRIPT = "id STRING, speaker STRING, text STRING, language STRING, languageConfidence DOUBLE, isFinal BOOLEAN, tStartMs BIGINT, tEndMs BIGINT, emittedMs BIGINT, confidence DOUBLE"
DIAGNOSTICS = "tsMs BIGINT, remoteRms DOUBLE, selfRms DOUBLE, droppedRemote BIGINT, droppedSelf BIGINT"
ASSIST = "id STRING, transcriptId STRING, segmentId STRING, sourceText STRING, questionTr STRING, answerEn STRING, helperAnswerTr STRING, confidence DOUBLE, qualityFlags ARRAY<STRING>, latencyMs DOUBLE, firstTokenMs DOUBLE, reviewLabel STRING, reviewTags ARRAY<STRING>, reviewComment STRING, reviewedAtMs BIGINT, state STRING, rawText STRING, error STRING, contextLinesUsed ARRAY<STRING>, personalizationMode STRING, parseMode STRING, fallbackUsed BOOLEAN, riskFlags ARRAY<STRING>"


def struct_fields(ddl: str) -> str:
    """Top-level DDL fields as the inside of STRUCT<...>."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return ", ".join(out)


SESSION = f"schemaVersion STRING, id STRING, startedAtMs BIGINT, endedAtMs BIGINT, sttModel STRING, inferenceModel STRING, transcripts ARRAY<STRUCT<{struct_fields(TRANSCRIPT)}>>, assists ARRAY<STRUCT<{struct_fields(ASSIST)}>>"
WEB_CORPUS = "id STRING, url STRING, title STRING, category STRING, origin STRING, tier STRING, source_domain STRING, language STRING, quality_score DOUBLE, extract_method STRING, text_hash STRING, fetched_at BIGINT, text STRING"
EXTERNAL_QA = "id STRING, question STRING, reply_en STRING, reply_tr STRING, source STRING, dataset_id STRING, dataset_url STRING, license STRING, category STRING, language STRING, quality_score DOUBLE, imported_at BIGINT"
GLOSSARY = "term STRING, definition_en STRING, definition_tr STRING, tags ARRAY<STRING>, source STRING"
SFT = "schema_version STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>, metadata STRUCT<source: STRING, source_bucket: STRING, category: STRING, candidate_specific: BOOLEAN, judge_status: STRING, quality_score: DOUBLE, session_id: STRING, critical_failure_tags: ARRAY<STRING>>"
WORKER = "type STRING, id STRING, speaker STRING, text STRING, language STRING, confidence DOUBLE, tStartMs BIGINT, tEndMs BIGINT, emittedMs BIGINT, tsMs BIGINT, remoteRms DOUBLE, selfRms DOUBLE, message STRING"

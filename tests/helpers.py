"""Doubles for models, and small stores."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timezone

from factloom.operators.snapshot import SCHEMAS, Snapshot
from factloom.sources.judging import Ruling

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


class HashEmbedder:
    """Bags of words in 64 dimensions."""

    provider, model = "hash", "bow64"

    def __init__(self):
        self.calls = 0

    def embed(self, texts):
        self.calls += 1
        out = []
        for t in texts:
            v = [0.0] * 64
            for w in re.findall(r"\w+", t.lower()):
                v[int(hashlib.md5(w.encode()).hexdigest(), 16) % 64] += 1.0
            out.append(v if any(v) else [1.0] + v[1:])
        return out


class FailingEmbedder(HashEmbedder):
    def embed(self, texts):
        self.calls += 1
        raise OSError("down")


class ScriptedExtractor:
    def __init__(self, *payloads):
        self.payloads = list(payloads)

    def extract(self, text):
        return self.payloads.pop(0)


class KeywordExtractor:
    """One fact per turn: what the user said. Can be sent to executors."""

    def extract(self, text):
        said = text.split("\n")[0].removeprefix("User: ")
        return {"memories": [fact(said)]}


class ScriptedJudge:
    def __init__(self, relation=None, merged=None, error=None):
        self.relation, self.merged, self.error, self.seen = relation, merged, error, []

    def judge(self, new_fact, candidates):
        self.seen.append([c["content"] for c in candidates])
        if self.error:
            raise self.error
        return Ruling.of({c["id"]: self.relation for c in candidates}, self.merged)


def fact(content, **more):
    return {"content": content, "memory_type": "world", "subtype": "fact", "confidence": 0.8, "importance": 0.6, "durable": True, "entities": [], "relationships": []} | more


def table(spark, name, rows):
    """Rows as dicts; what they leave out is null, or a usual value."""
    usual = {"memory_type": "world", "confidence": 0.5, "importance": 0.5, "status": "active", "recall_count": 0, "created_at": datetime(2024, 1, 1), "updated_at": datetime(2024, 1, 1), "role": "mentioned", "aliases": [], "provider": "p", "model": "m"}
    columns = [c.split(" ", 1)[0] for c in SCHEMAS[name].split(", ")]
    out = []
    for r in rows:
        r = {k: v for k, v in usual.items() if k in columns} | r
        if name == "memories":
            r.setdefault("normalized_content", " ".join(r["content"].lower().split()))
        if name == "memory_embeddings":
            r = {"dimension": len(r["vector"])} | r
        out.append(tuple(r.get(c) for c in columns))
    return spark.createDataFrame(out, SCHEMAS[name])


def store_of(spark, **tables):
    return Snapshot(**{n: table(spark, n, tables.get(n, [])) for n in SCHEMAS})


def ids(df, column="id"):
    return [r[column] for r in df.collect()]

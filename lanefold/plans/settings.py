"""Settings as nested dicts with the surveyed defaults and checks; environment variables override the model server's address."""

from __future__ import annotations

import json
import os
from copy import deepcopy

#: The required keys with their defaults.
DEFAULTS = {
    "llm": {"model_name": "", "base_url": "http://localhost:11434", "temperature": 0.0, "max_tokens": 200, "timeout": 60, "max_docs": 5, "max_context_chars": 3500, "max_chars_per_doc": 800},
    "embeddings": {"model_name": "hashed-trigrams"},
    "vector_store": {"top_k_vectors": 20, "similarity_threshold": 0.0, "distance_metric": "cosine"},
    "graph": {"max_hops": 2, "top_k_entities": 20, "hub_mention_cap": 280, "hub_fanout_cap": 280, "search_budget_seconds": 0.0, "enable_hop3": False},
    "rag": {"retrieval_mode": "hybrid", "rrf_k": 60, "cross_source_boost": 1.2, "enable_bm25": True, "bm25_top_k": 20, "vector_weight": 1.0, "graph_weight": 1.0, "bm25_weight": 1.0},
    "navigator": {"relevance_threshold_factor": 0.6, "redundancy_threshold": 0.8, "max_context_chunks": 8, "top_k_per_subquery": 20, "rrf_k": 60, "enable_reranker": False, "contradiction_min_value": 100},
    "verifier": {"entity_coverage_threshold": 0.34, "confidence_high_threshold": 0.8},
    "agent": {"max_verification_iterations": 2, "enable_verifier": True},
    "entity_extraction": {"gliner": {"confidence_threshold": 0.15}},
    "ingestion": {"sentences_per_chunk": 3, "sentence_overlap": 1, "min_chunk_chars": 50, "max_chunk_chars": 2000},
    "benchmark": {"answer_f1_threshold": 0.6},
}
#: keys with a default that a file need not name
OPTIONAL = {"rag.vector_weight", "rag.graph_weight", "rag.bm25_weight", "ingestion.sentence_overlap", "ingestion.min_chunk_chars", "ingestion.max_chunk_chars"}
#: Fixed value: the precision that a model's bare name stands for.
BARE_BITWIDTH = "q4_k_m"


def flat(tree: dict, head: str = "") -> dict[str, object]:
    """Nested settings as dotted keys."""
    out: dict[str, object] = {}
    for k, v in tree.items():
        out |= flat(v, f"{head}{k}.") if isinstance(v, dict) else {f"{head}{k}": v}
    return out


def put(tree: dict, key: str, value: object) -> None:
    *path, last = key.split(".")
    for p in path:
        if not isinstance(tree.get(p), dict):
            tree[p] = {}
        tree = tree[p]
    tree[last] = value


def scalar(text: str) -> object:
    """A plain value: quoted text, true or false, null, a number, or the text itself."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    try:
        return json.loads({"True": "true", "False": "false", "~": "null", "yes": "true", "no": "false"}.get(text, text))
    except ValueError:
        return text


def parse_indented(text: str) -> dict:
    """The maps of an indented key: value file; comments are dropped, lists of plain values read, anything else is an error."""
    root: dict = {}
    stack: list[tuple[int, dict, str | None]] = [(-1, root, None)]
    for number, line in enumerate(text.splitlines(), 1):
        bare = line.split(" #")[0] if not line.lstrip().startswith("#") else ""
        if not bare.strip() or bare.strip() == "---":
            continue
        indent = len(bare) - len(bare.lstrip())
        body = bare.strip()
        while stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent):
            stack.pop()
        _, holder, key = stack[-1]
        if body.startswith("- "):
            if key is None:
                raise ValueError(f"line {number}: a list without a key")
            if not isinstance(holder[key], list):
                holder[key] = []
            holder[key].append(scalar(body[2:]))
            continue
        name, colon, value = body.partition(":")
        if not colon:
            raise ValueError(f"line {number}: no key")
        target = holder if key is None else holder[key]
        if not isinstance(target, dict):
            raise ValueError(f"line {number}: a key inside a list or value")
        target[name.strip()] = scalar(value) if value.strip() else {}
        if not value.strip():
            stack.append((indent, target, name.strip()))
    return root


def load_settings(path: str | None = None) -> tuple[dict, list[str]]:
    """(settings, warnings) of a JSON or indented file; a missing or broken file gives the defaults.

    Every required key that the file lacks is a warning and takes its default, every unknown one is kept with a warning.
    OLLAMA_HOST overrides the model server's address.
    """
    notes = []
    try:
        with open(path or os.environ.get("CONFIG_PATH", "config/settings.yaml")) as f:
            text = f.read()
        raw = json.loads(text) if text.lstrip().startswith("{") else parse_indented(text)
    except (OSError, TypeError, ValueError) as e:
        raw, notes = {}, [f"defaults are used: {e}"]
    given, known = flat(raw), flat(DEFAULTS)
    notes += [f"missing key {k}" for k in known if k not in given and k not in OPTIONAL] + [f"unknown key {k}" for k in sorted(given) if k not in known]
    out = deepcopy(DEFAULTS)
    for k, v in given.items():
        put(out, k, v)
    if os.environ.get("OLLAMA_HOST"):
        put(out, "llm.base_url", os.environ["OLLAMA_HOST"])
    return out, notes


def differences(frozen: dict, live: dict) -> dict[str, tuple]:
    """Settings that differ, as dotted key to both values; None where one side lacks it."""
    a, b = flat(frozen), flat(live)
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def parse_configs(spec: str) -> list[tuple[int, int]]:
    """D06: "3:1,5:1" as pairs of sentences and overlap; anything else raises ValueError."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        width, _, overlap = part.partition(":")
        pair = int(width), int(overlap or 0)
        if pair[0] < 1 or not 0 <= pair[1] < pair[0]:
            raise ValueError("the overlap must be from 0 to below the number of sentences of a chunk")
        out.append(pair)
    return out


def expand_bitwidths(base: str, widths: list[str]) -> list[dict[str, str]]:
    """One model variant per bit width that is not blank; the bare name stands for BARE_BITWIDTH."""
    named = [w.strip() for w in widths if w.strip()]
    return [{"tag": base if w.lower() == BARE_BITWIDTH else f"{base}-{w}", "bitwidth": w, "base": base} for w in named]


def cell(settings: dict, changes: dict[str, object]) -> dict:
    """The settings of an ablation cell, dotted changes over a base; an unknown key raises KeyError."""
    out, known = deepcopy(settings), flat(settings)
    for k, v in changes.items():
        if k not in known:
            raise KeyError(k)
        put(out, k, v)
    return out

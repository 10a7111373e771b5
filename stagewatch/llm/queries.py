"""All queries of this subpackage; importing the operators' modules registers theirs."""

from stagewatch.llm import bpe, credentials, decontamination, hard_negatives, html_text, jaccard_join, periodic_runs, pii, sharding, token_records, topk, toxicity, warc  # noqa: F401
from stagewatch.llm.registry import ORACLES, QUERIES  # noqa: F401

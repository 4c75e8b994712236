"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from granary.llm import stages
from granary.llm.decontaminate import OP1_SQL, op1_decontaminate
from granary.llm.licenses import OP4_SQL, op4_licenses
from granary.llm.merkle import OP11_SQL, op11_manifest
from granary.llm.mixing import op7_mixing
from granary.llm.neighbours import op5_neighbours
from granary.llm.oddsketch import OP12_SQL, op12_minhash
from granary.llm.quality import op9_quality
from granary.llm.resample import OP13_SQL, op13_resample
from granary.llm.simhash import op6_simhash
from granary.llm.substrings import OP10_SQL, op10_substrings
from granary.llm.toxicity import op2_toxicity
from granary.llm.urls import op8_urls
from granary.llm.warc import OP3_SQL, op3_warc
from granary.plans.registry import shipped

QUERIES = {
    f.__name__: shipped(f)
    for f in (op1_decontaminate, op2_toxicity, op3_warc, op4_licenses, op5_neighbours, op6_simhash, op7_mixing, op8_urls, op9_quality, op10_substrings, op11_manifest, op12_minhash, op13_resample)
}
QUERIES["pipeline"] = shipped(stages.run)
SQL = {"op1_decontaminate": OP1_SQL, "op3_warc": OP3_SQL, "op4_licenses": OP4_SQL, "op10_substrings": OP10_SQL, "op11_manifest": OP11_SQL, "op12_minhash": OP12_SQL, "op13_resample": OP13_SQL}

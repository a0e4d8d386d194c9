"""Queries of this subpackage for the driver's entry module."""

from __future__ import annotations

from verdigris.llm import html_extract, lexical_search, license_scan, minhash_join, mixture, ngram_join, periodic_runs, sharding, suffix_dedup
from verdigris.llm.decontam import op6_decontaminate
from verdigris.llm.html_extract import op2_html_extract
from verdigris.llm.lexical_search import op11_lexical_search
from verdigris.llm.license_scan import op4_license_scan
from verdigris.llm.media import op5_media
from verdigris.llm.minhash_join import op13_minhash_join
from verdigris.llm.mixture import op8_mixture
from verdigris.llm.ngram_join import op7_ngram_join
from verdigris.llm.periodic_runs import op12_periodic_runs
from verdigris.llm.secret_scan import op9_secret_scan
from verdigris.llm.sharding import op10_sharding
from verdigris.llm.suffix_dedup import op1_suffix_dedup
from verdigris.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_media": op5_media,
    "op6_decontaminate": op6_decontaminate,
    "op7_ngram_join": op7_ngram_join,
    "op8_mixture": op8_mixture,
    "op9_secret_scan": op9_secret_scan,
    "op10_sharding": op10_sharding,
    "op11_lexical_search": op11_lexical_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minhash_join": op13_minhash_join,
}
#: Where SQL can say it; tests hold the others against brute force.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op2_html_extract": html_extract.ORACLE_SQL,
    "op4_license_scan": license_scan.oracle_sql(),
    "op7_ngram_join": ngram_join.ORACLE_SQL,
    "op8_mixture": mixture.ORACLE_SQL,
    "op10_sharding": sharding.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_periodic_runs": periodic_runs.ORACLE_SQL,
    "op13_minhash_join": minhash_join.ORACLE_SQL,
}

"""Registered queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from .cube_mix import op2_cube_mix
from .decontam import op4_decontam
from .kn_lm import op6_kn_lm
from .license_scan import op9_license_scan
from .ngram_join import op7_ngram_join
from .periodic_runs import op11_periodic_runs
from .piece_codec import op13_pieces
from .quality_gam import op1_quality_gam
from .quality_rules import op8_quality_rules
from .secret_scan import op5_secret_scan
from .substring_dedup import op10_substring_dedup
from .toxic_cnn import op3_toxic_cnn
from .whitening import op12_whitening

QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_cube_mix": op2_cube_mix,
    "op3_toxic_cnn": op3_toxic_cnn,
    "op4_decontam": op4_decontam,
    "op5_secret_scan": op5_secret_scan,
    "op6_kn_lm": op6_kn_lm,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_whitening": op12_whitening,
    "op13_pieces": op13_pieces,
}

#: DuckDB SQL by query name, for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {}

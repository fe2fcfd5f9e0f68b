"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, divergence, jaccard, linededup, resample, urlfilter
from .bpe import op6_bpe
from .chat import op12_chat
from .decontaminate import op2_decontaminate
from .divergence import op13_divergence
from .htmltext import op3_html
from .jaccard import op9_jaccard
from .licences import op4_licences
from .linededup import op1_line_dedup
from .media import op7_media
from .quality import op5_quality
from .resample import op11_resample
from .urlfilter import op8_url_filter
from .wordpiece import op10_token_counts

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_html": op3_html,
    "op4_licences": op4_licences,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_media": op7_media,
    "op8_url_filter": op8_url_filter,
    "op9_jaccard": op9_jaccard,
    "op10_token_counts": op10_token_counts,
    "op11_resample": op11_resample,
    "op12_chat": op12_chat,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op1_line_dedup": linededup.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op9_jaccard": jaccard.ORACLE,
    "op11_resample": resample.ORACLE,
    "op13_divergence": divergence.ORACLE,
}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, licenses, media, merkle, packing, quality, shard, suffix, urlfilter, vectors, warc, whiten

QUERIES = {
    "op1_shard": shard.op1_shard,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_licenses": licenses.op3_licenses,
    "op4_suffix": suffix.op4_suffix,
    "op5_quality": quality.op5_quality,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_packing": packing.op7_packing,
    "op8_media": media.op8_media,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_warc": warc.op10_warc,
    "op11_vectors": vectors.op11_vectors,
    "op12_whiten": whiten.op12_whiten,
    "op13_merkle": merkle.op13_merkle,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op4_suffix": suffix.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_vectors": vectors.ORACLE,
    "op13_merkle": merkle.ORACLE,
}

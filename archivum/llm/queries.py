"""Queries of the operators for training data, with their SQL where SQL can express them."""

from __future__ import annotations

from archivum.llm import canonical_values, components, contamination, matching, mojibake, packing, survivorship
from archivum.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "p3_found": survivorship.p3_found,
    "p3_survivors": survivorship.p3_survivors,
    "p4_found": matching.p4_found,
    "p4_matches": matching.p4_matches,
    "p5_found": canonical_values.p5_found,
    "p5_misses": canonical_values.p5_misses,
    "p7_found": components.p7_found,
    "p8_pack": packing.p8_pack,
    "p8_fill": packing.p8_fill,
    "p9_found": contamination.p9_found,
    "p9_items": contamination.p9_items,
    "p10_found": mojibake.p10_found,
    "p10_restored": mojibake.p10_restored,
}

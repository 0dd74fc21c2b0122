"""Every query of this subpackage, by importing the modules that register them."""

from paceline.llm import alignment, chat_formatting, hard_negatives, language_id, license_scans, nearest, packing, piece_encoding, quality_rules, simhash, substring_dedup, suffix_dedup, url_filters  # noqa: F401
from paceline.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""The registered corpus queries; importing the operator modules registers them."""

from wirefold.llm import (collocations, context_mixing, decontaminate, line_dedup, line_rules, merkle, mixing, ngram_join,  # noqa: F401
                          pii, rans, repeats, url_rules, warc)
from wirefold.llm.common import ORACLE, QUERIES  # noqa: F401

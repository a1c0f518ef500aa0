"""Main text on pages labelled by hand, against the rule that labels the training pages."""

import os
import sys

from loomgrid.llm import html_extract as H

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from labelled_pages import labelled  # noqa: E402


def counts(label):
    """True and false positives and false negatives over the blocks of all pages."""
    tp = fp = fn = 0
    for page, marked in labelled():
        blocks, want = H.blocks_of(page), [b.text.startswith("§") for b in H.blocks_of(marked)]
        assert len(blocks) == len(want)
        for wanted, got in zip(want, label(blocks) or [0] * len(blocks), strict=True):
            tp, fp, fn = tp + bool(wanted and got), fp + bool(got and not wanted), fn + bool(wanted and not got)
    return tp, fp, fn


def test_the_field_reads_layouts_that_the_rule_cannot(spark):
    """Trained on the tables' pages alone; the rule needs an article or main element, which these pages lack."""
    model = H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    tp, fp, fn = counts(model.label)
    assert tp / (tp + fp) >= 0.85 and tp / (tp + fn) >= 0.85
    assert counts(H.told)[0] == 0

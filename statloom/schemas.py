"""Schemas of stored models and of the delimited inputs."""

from __future__ import annotations

NODE_SCHEMA = (
    "node_id STRING, parent_id STRING, depth INT, edge_feature STRING, edge_value STRING, "
    "split_feature STRING, n_rows BIGINT, label STRING, is_leaf BOOLEAN, gain DOUBLE"
)
WORD_MODEL_SCHEMA = (
    "word STRING, n_seen BIGINT, n1 BIGINT, n0 BIGINT, log_p1 DOUBLE, log_p0 DOUBLE"
)
WORD_COUNTS_SCHEMA = "word STRING, n_seen BIGINT, n1 BIGINT, n0 BIGINT"
DOC_COUNTS_SCHEMA = "n_docs BIGINT, n_pos BIGINT, last_batch BIGINT"
PRIOR_SCHEMA = "n_docs BIGINT, p1 DOUBLE, den1 DOUBLE, den0 DOUBLE"
PERCEPTRON_SCHEMA = "epoch INT, misclassified BIGINT, w ARRAY<DOUBLE>, b DOUBLE"

# Column names of the contact-lens rows.
LENSES_SCHEMA = "age STRING, prescript STRING, astigmatic STRING, tearRate STRING, label STRING"

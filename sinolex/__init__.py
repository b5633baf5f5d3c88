"""Chinese text analytics on Spark: normalisation, rules, segmentation, tagging, training, evaluation."""

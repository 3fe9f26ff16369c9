"""Spark-native scoring of many sparse additive scores over large genotype cohorts."""

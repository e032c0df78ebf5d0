"""The analytic workload: queries built from the operators, and their SQL."""

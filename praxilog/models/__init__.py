"""Predictors of right answers: fitted by aggregations, applied by joins and windows."""

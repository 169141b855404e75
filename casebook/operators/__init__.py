"""Operators: plain functions ``DataFrame(s) -> DataFrame`` over built-in Spark expressions.

corpus      cutoff, bounded per-patient history, first future event, prompt samples
explore     counts, top-N, describe, histograms, box statistics, age at encounter
metrics     accuracy, P/R/F1, class report, confusion, latency rollup, calibration
routing     keyword router, route summary, fan-out to stored answers
answers     candidate blocks, numbered lists, JSON / delimited / sectioned answer parsers
consensus   softmax and majority voting, score tables, case pipeline
splits      domain lookup and fan-out, exact hash splits, stratified split, sampling
evalslice   last condition per patient, vignettes, stratified sample, metadata
validate    VARIANT-based record validation, sanitising, emergency flags, quality report
tfidf       relational TF-IDF, top terms, label encoding, Spark ML logistic baseline
ordering    exact global row index without single-partition windows; hash order key
quantiles   exact quantiles with bounded per-group memory
"""

"""Training-data operators: one module per operator, Spark jobs throughout.

pii             regex spans, checksum validators, context score        (native)
token_file      token ids as directly addressable codes, written and read back
html_extract    main text of pages by a bidirectional LSTM block labeller
language_id     hyperdimensional n-gram profiles
quality_rules   base quality features and a learned decision list      (native)
simhash         SimHash fingerprints, pigeonhole block join, components
decontaminate   positional inverted index against a benchmark          (native)
line_crf        linear-chain CRF over lines, aggregated to a document score
token_count     token counts in byte-balanced Arrow batches
mix             Poisson replication towards target source weights      (native)
conversations   conversation repair by cheapest edits; survivors holds its back-pointer tree
lexical         ranked lexical search by classes of equal item vectors
vector_search   exact top-k inner products by columnar branch and bound
queries         the registered queries and their SQL twins

Nothing outside this folder imports it but the driver contract's guarded entry.
"""

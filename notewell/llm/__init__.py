"""Operations of a large training-data pipeline: near-duplicate joins, decontamination, classifiers, sharding, mixing, output.

Nothing outside this package imports it; `queries` lists what it registers.
"""

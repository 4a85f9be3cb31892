"""Operations of a training-data pipeline: packing, scoring, filters, dedup, formats."""

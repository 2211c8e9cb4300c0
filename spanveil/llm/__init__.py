"""Operations of a training-data pipeline: filters, scoring, near duplicates, mixing, sharding and packing."""

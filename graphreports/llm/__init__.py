"""Operations of a training-data pipeline: filtering, de-duplication, scoring, extraction, mixing and packing of documents."""

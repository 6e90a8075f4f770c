"""Readers and writers: referral CSV feeds, Parquet tables, result tables, JSON summaries."""

"""Readers that turn raw files and pages into blocks."""

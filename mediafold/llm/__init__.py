"""Operators of a training-data pipeline. ``catalog`` lists their queries; nothing outside this folder imports it."""

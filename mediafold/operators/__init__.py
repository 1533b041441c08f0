"""DataFrame operators: vocabularies, zero-shot tags, merging, rendering, endpoint calls, signal and image preparation."""

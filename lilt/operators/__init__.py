"""DataFrame to DataFrame operators over words, phrases, frames, segments, jobs and audio blocks."""

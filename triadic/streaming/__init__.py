"""An extension beyond batch fits: spectra of completed blocks from a stream."""

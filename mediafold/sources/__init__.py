"""Files as rows: directory listing, headers, hashes, and facts from external programs."""

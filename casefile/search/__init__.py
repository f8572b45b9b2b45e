"""Search over file content: strings, keyword index, media types."""

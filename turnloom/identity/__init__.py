"""Who speaks: evidence of voices, profiles, and the identity model."""

"""Rules, reports, outputs and samples built from columns and operators."""

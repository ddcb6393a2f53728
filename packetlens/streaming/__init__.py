"""packetlens streaming"""
